"""Public holidays of the calendar source's countries.

A day's rule is a date ``MM-DD``; ``E+n`` or ``E-n``, days from Easter Sunday, or ``O+n``, from Orthodox Easter; or
``MM-DD>Day``, the first such weekday on or after a date. A rule can be followed by the first and last year it holds in.
Names are English. Only days off in the whole country count, and only the countries of ``SUBSTITUTES`` move days.
"""

from __future__ import annotations

import datetime as dt

#: Each country's holidays, as rule, name and years.
HOLIDAYS = {
    "AT": """01-01 New Year's Day|01-06 Epiphany|E+1 Easter Monday|05-01 Labour Day|E+39 Ascension Day|E+50 Whit Monday|E+60 Corpus Christi|08-15 Assumption Day
        10-26 National Day|11-01 All Saints' Day|12-08 Immaculate Conception|12-25 Christmas Day|12-26 Saint Stephen's Day""",
    "BE": """01-01 New Year's Day|E+0 Easter Sunday|E+1 Easter Monday|05-01 Labour Day|E+39 Ascension Day|E+49 Whit Sunday|E+50 Whit Monday|07-21 National Day
        08-15 Assumption Day|11-01 All Saints' Day|11-11 Armistice Day|12-25 Christmas Day""",
    "BG": """01-01 New Year's Day|03-03 Liberation Day|O-2 Good Friday|O-1 Holy Saturday|O+0 Easter Sunday|O+1 Easter Monday|05-01 Labour Day|05-06 Saint George's Day
        05-24 Day of Letters|09-06 Unification Day|09-22 Independence Day|12-24 Christmas Eve|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "CH": "01-01 New Year's Day|E+39 Ascension Day|08-01 National Day|12-25 Christmas Day",
    "CZ": """01-01 New Year's Day|E-2 Good Friday 2016-|E+1 Easter Monday|05-01 Labour Day|05-08 Victory Day|07-05 Saints Cyril and Methodius Day|07-06 Jan Hus Day
        09-28 Statehood Day|10-28 Independence Day|11-17 Freedom and Democracy Day|12-24 Christmas Eve|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "DE": """01-01 New Year's Day|E-2 Good Friday|E+1 Easter Monday|05-01 Labour Day|E+39 Ascension Day|E+50 Whit Monday|10-03 German Unity Day|10-31 Reformation Day 2017-2017
        12-25 Christmas Day|12-26 Second Day of Christmas""",
    "DK": """01-01 New Year's Day|E-3 Maundy Thursday|E-2 Good Friday|E+0 Easter Sunday|E+1 Easter Monday|E+26 Great Prayer Day -2023|E+39 Ascension Day|E+49 Whit Sunday
        E+50 Whit Monday|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "ES": """01-01 New Year's Day|01-06 Epiphany|E-2 Good Friday|05-01 Labour Day|08-15 Assumption Day|10-12 National Day|11-01 All Saints' Day|12-06 Constitution Day
        12-08 Immaculate Conception|12-25 Christmas Day""",
    "FI": """01-01 New Year's Day|01-06 Epiphany|E-2 Good Friday|E+0 Easter Sunday|E+1 Easter Monday|05-01 May Day|E+39 Ascension Day|E+49 Whit Sunday|06-20>Sat Midsummer Day
        10-31>Sat All Saints' Day|12-06 Independence Day|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "FR": """01-01 New Year's Day|E+1 Easter Monday|05-01 Labour Day|05-08 Victory Day|E+39 Ascension Day|E+50 Whit Monday|07-14 National Day|08-15 Assumption Day
        11-01 All Saints' Day|11-11 Armistice Day|12-25 Christmas Day""",
    "GB": """01-01 New Year's Day|E-2 Good Friday|05-01>Mon May Day -2019|05-08 May Day 2020-2020|05-01>Mon May Day 2021-|05-25>Mon Spring Bank Holiday -2021|06-02 Spring Bank Holiday 2022-2022
        06-03 Platinum Jubilee 2022-2022|05-25>Mon Spring Bank Holiday 2023-|09-19 State Funeral 2022-2022|05-08 Coronation 2023-2023|12-25 Christmas Day|12-26 Boxing Day""",
    "GR": """01-01 New Year's Day|01-06 Epiphany|O-48 Clean Monday|03-25 Independence Day|O-2 Good Friday|O+1 Easter Monday|05-01 Labour Day|O+50 Whit Monday
        08-15 Assumption Day|10-28 Ochi Day|12-25 Christmas Day|12-26 Glorifying Mother of God""",
    "HU": """01-01 New Year's Day|03-15 National Day|E-2 Good Friday 2017-|E+0 Easter Sunday|E+1 Easter Monday|05-01 Labour Day|E+49 Whit Sunday|E+50 Whit Monday
        08-20 State Foundation Day|10-23 National Day|11-01 All Saints' Day|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "IE": """01-01 New Year's Day|02-01>Mon Saint Brigid's Day 2023-|03-17 Saint Patrick's Day|03-18 Day of Remembrance 2022-2022|E+1 Easter Monday|05-01>Mon May Day
        06-01>Mon June Bank Holiday|08-01>Mon August Bank Holiday|10-25>Mon October Bank Holiday|12-25 Christmas Day|12-26 Saint Stephen's Day""",
    "IT": """01-01 New Year's Day|01-06 Epiphany|E+0 Easter Sunday|E+1 Easter Monday|04-25 Liberation Day|05-01 Labour Day|06-02 Republic Day|08-15 Assumption Day
        11-01 All Saints' Day|12-08 Immaculate Conception|12-25 Christmas Day|12-26 Saint Stephen's Day""",
    "NL": """01-01 New Year's Day|E+0 Easter Sunday|E+1 Easter Monday|04-30 Queen's Day -2013|04-27 King's Day 2014-|E+39 Ascension Day|E+49 Whit Sunday|E+50 Whit Monday
        12-25 Christmas Day|12-26 Second Day of Christmas""",
    "NO": """01-01 New Year's Day|E-3 Maundy Thursday|E-2 Good Friday|E+0 Easter Sunday|E+1 Easter Monday|05-01 Labour Day|05-17 Constitution Day|E+39 Ascension Day
        E+49 Whit Sunday|E+50 Whit Monday|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "PL": """01-01 New Year's Day|01-06 Epiphany 2011-|E+0 Easter Sunday|E+1 Easter Monday|05-01 Labour Day|05-03 Constitution Day|E+49 Pentecost|E+60 Corpus Christi
        08-15 Assumption Day|11-01 All Saints' Day|11-11 Independence Day|12-24 Christmas Eve 2025-|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "PT": """01-01 New Year's Day|E-2 Good Friday|E+0 Easter Sunday|04-25 Freedom Day|05-01 Labour Day|E+60 Corpus Christi -2012|E+60 Corpus Christi 2016-|06-10 Portugal Day
        08-15 Assumption Day|10-05 Republic Day -2012|10-05 Republic Day 2016-|11-01 All Saints' Day -2012|11-01 All Saints' Day 2016-|12-01 Independence Day -2012
        12-01 Independence Day 2016-|12-08 Immaculate Conception|12-25 Christmas Day""",
    "RO": """01-01 New Year's Day|01-02 Second Day of New Year|01-06 Epiphany 2024-|01-07 Saint John the Baptist 2024-|01-24 Unification Day 2017-|O-2 Good Friday 2018-|O+0 Easter Sunday
        O+1 Easter Monday|05-01 Labour Day|06-01 Children's Day 2017-|O+49 Pentecost|O+50 Whit Monday|08-15 Assumption Day|11-30 Saint Andrew's Day 2012-|12-01 National Day
        12-25 Christmas Day|12-26 Second Day of Christmas""",
    "SE": """01-01 New Year's Day|01-06 Epiphany|E-2 Good Friday|E+0 Easter Sunday|E+1 Easter Monday|05-01 May Day|E+39 Ascension Day|E+49 Whit Sunday|06-06 National Day 2005-
        06-20>Sat Midsummer Day|10-31>Sat All Saints' Day|12-25 Christmas Day|12-26 Second Day of Christmas""",
    "SK": """01-01 Republic Day|01-06 Epiphany|E-2 Good Friday|E+1 Easter Monday|05-01 Labour Day|05-08 Victory Day|07-05 Saints Cyril and Methodius Day
        08-29 National Uprising|09-01 Constitution Day -2023|09-15 Our Lady of Sorrows|11-01 All Saints' Day|11-17 Freedom and Democracy Day -2024|12-24 Christmas Eve
        12-25 Christmas Day|12-26 Second Day of Christmas""",
}
#: Countries where a holiday on Saturday or Sunday gives the next free weekday off, since when, and for which rules.
SUBSTITUTES = {"BG": (2017, "0 1"), "GB": (1974, "01-01 12-25 12-26"), "IE": (1974, "01-01 03-17 12-25 12-26")}
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def easter(year: int) -> dt.date:
    """Easter Sunday by the Gregorian computus."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= (epact // 28) * (1 - (epact // 28) * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    shift = epact - weekday
    month = 3 + (shift + 40) // 44
    return dt.date(year, month, shift + 28 - 31 * (month // 4))


def orthodox_easter(year: int) -> dt.date:
    """Easter Sunday by the Julian computus, as a Gregorian date."""
    moon = (19 * (year % 19) + 15) % 30
    weekday = (2 * (year % 4) + 4 * (year % 7) - moon + 34) % 7
    julian = moon + weekday + 114
    gap = year // 100 - year // 400 - 2
    return dt.date(year, julian // 31, julian % 31 + 1) + dt.timedelta(gap)


def _rules(country: str) -> list[tuple[str, str, int, int]]:
    out = []
    for line in HOLIDAYS[country].replace("\n", "|").split("|"):
        rule, name = line.strip().split(" ", 1)
        first, last = 1, 9999
        head, _, years = name.rpartition(" ")
        if "-" in years and years.replace("-", "").isdigit():
            name, (a, b) = head, years.split("-")
            first, last = int(a or 1), int(b or 9999)
        out.append((rule, name, first, last))
    return out


def _day(rule: str, year: int) -> dt.date:
    if rule[0] in "EO":
        return (easter if rule[0] == "E" else orthodox_easter)(year) + dt.timedelta(int(rule[1:]))
    date, _, weekday = rule.partition(">")
    day = dt.date(year, *map(int, date.split("-")))
    return day + dt.timedelta((WEEKDAYS.index(weekday) - day.weekday()) % 7) if weekday else day


def holidays(country: str, years: range) -> dict[dt.date, str]:
    """Each holiday's date and name; of two on a day the first listed gives the name."""
    if country not in HOLIDAYS:
        raise ValueError(f"No holidays known for {country}")
    out: dict[dt.date, str] = {}
    since, which = SUBSTITUTES.get(country, (9999, ""))
    for y in years:
        found = [(_day(rule, y), rule, name) for rule, name, first, last in _rules(country) if first <= y <= last]
        if country == "NL":
            found = [(d - dt.timedelta(1) if rule == "04-27" and d.weekday() == 6 else d, rule, name) for d, rule, name in found]
        if country == "IE" and y >= 2023 and dt.date(y, 2, 1).weekday() == 4:
            found = [(dt.date(y, 2, 1) if rule == "02-01>Mon" else d, rule, name) for d, rule, name in found]
        for d, _, name in found:
            out.setdefault(d, name)
        for d, rule, name in sorted(found):
            if y >= since and d.weekday() >= 5 and rule.startswith(tuple(which.split())):
                while d in out or d.weekday() >= 5:
                    d += dt.timedelta(1)
                out[d] = f"{name} (observed)"
    return dict(sorted(out.items()))
