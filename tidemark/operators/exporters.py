"""Exports of reports: plain text and a workbook. All tables come from one pass over the predictions."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from .report import EvaluationReport

VIEWS = ("summary", "hour", "horizon", "hour_horizon", "year", "year_horizon")


class TerminalExporter:
    def __init__(self, show: Sequence[str] = ("summary", "horizon")):
        self.show = list(show)

    def params(self) -> dict:
        return {"show": self.show}

    def render(self, report: EvaluationReport) -> str:
        out, tables, metrics = [], report.tables(), [e.name for e in report.evaluators]
        for name in [v for v in VIEWS if v in self.show]:
            names = ["model", *([] if name == "summary" else name.split("_")), *metrics]
            rows = [[f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names] for r in tables[name]]
            widths = [max(map(len, c)) for c in zip(names, *rows)]
            out += [f"== {name} ==", *["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [names, *rows]], ""]
        return "\n".join(out)

    def export(self, report: EvaluationReport) -> None:
        print(self.render(report))


class Sheet:
    """Cells by (row, column), both from 1, and ranges that are coloured from least to greatest."""

    def __init__(self, name: str):
        self.name, self.cells, self.scales = name[:31], {}, []

    def put(self, row: int, column: int, values: Iterable) -> None:
        self.cells |= {(row, column + i): v for i, v in enumerate(values)}

    def colour(self, row: int, column: int, rows: int, columns: int, each_column: bool = False) -> None:
        if rows <= 0 or columns <= 0:
            return
        spans = [(c, c) for c in range(column, column + columns)] if each_column else [(column, column + columns - 1)]
        self.scales += [f"{letters(a)}{row}:{letters(b)}{row + rows - 1}" for a, b in spans]

    def xml(self) -> str:
        rows: dict[int, dict[int, object]] = {}
        for (r, c), v in self.cells.items():
            rows.setdefault(r, {})[c] = v
        body = "".join(f'<row r="{r}">{"".join(_cell(r, c, rows[r][c]) for c in sorted(rows[r]))}</row>' for r in sorted(rows))
        marks = "".join(_scale(s, i) for i, s in enumerate(self.scales, 1))
        return f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{marks}</worksheet>'


_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def letters(n: int) -> str:
    """A column's name, from 1 on."""
    return (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def _cell(row: int, column: int, v: object) -> str:
    at = f'r="{letters(column)}{row}"'
    if v is None or v != v:
        return f"<c {at}/>"
    if isinstance(v, (int, float)):
        return f"<c {at}><v>{v!r}</v></c>"
    return f'<c {at} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def _scale(where: str, priority: int) -> str:
    """Green at the least value, yellow at the median, red at the greatest."""
    stops = '<cfvo type="min"/><cfvo type="percentile" val="50"/><cfvo type="max"/>'
    colours = "".join(f'<color rgb="FF{c}"/>' for c in ("63BE7B", "FFEB84", "F8696B"))
    return f'<conditionalFormatting sqref="{where}"><cfRule type="colorScale" priority="{priority}"><colorScale>{stops}{colours}</colorScale></cfRule></conditionalFormatting>'


class ExcelExporter:
    """Summary, pivots by hour, horizon and year for each metric, matrices with the models side by side, and details."""

    SHEETS = ("summary", "hour", "horizon", "hour_horizon", "year", "year_horizon", "details")

    def __init__(self, path: str, sheets: Sequence[str] = SHEETS):
        self.path, self.sheets = path, list(sheets)

    def params(self) -> dict:
        return {"path": self.path, "sheets": self.sheets}

    def pages(self, report: EvaluationReport) -> list[Sheet]:
        out, tables, metrics = [], report.tables(), [e.name for e in report.evaluators]
        for name in [s for s in self.SHEETS if s in self.sheets]:
            if name == "summary":
                out.append(_summary(tables["summary"], metrics))
            elif name == "details":
                out.append(_details(report, [r["model"] for r in tables["summary"]]))
            else:
                out += [(_matrix if "_" in name else _pivot)(tables[name], name, m) for m in metrics]
        return out

    def export(self, report: EvaluationReport) -> None:
        pages = self.pages(report)
        numbered = list(enumerate(pages, 1))
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i, _ in numbered)
        kinds = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
        sheets = "".join(f'<sheet name="{escape(p.name)}" sheetId="{i}" r:id="r{i}"/>' for i, p in numbered)
        links = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
        start = f'<Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types">{kinds}{types}</Types>')
            z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{start}</Relationships>')
            z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for i, page in numbered:
                z.writestr(f"xl/worksheets/sheet{i}.xml", page.xml())


def _summary(rows: list[dict], metrics: Sequence[str]) -> Sheet:
    sheet = Sheet("Summary")
    sheet.put(1, 1, ["model", *metrics])
    for i, r in enumerate(rows, 2):
        sheet.put(i, 1, [r["model"], *[r[m] for m in metrics]])
    sheet.colour(2, 2, len(rows), len(metrics))
    return sheet


def _pivot(rows: list[dict], key: str, metric: str) -> Sheet:
    """A row for each model; horizons are not comparable, so each has its own colour scale."""
    sheet, found = Sheet(f"{key}_{metric}"), sorted({r[key] for r in rows})
    models = list(dict.fromkeys(r["model"] for r in rows))
    value = {(r["model"], r[key]): r[metric] for r in rows}
    sheet.put(1, 1, [metric, *[f"{key}_{k}" for k in found]])
    for i, m in enumerate(models, 2):
        sheet.put(i, 1, [m, *[value.get((m, k)) for k in found]])
    sheet.colour(2, 2, len(models), len(found), each_column=key == "horizon")
    return sheet


def _matrix(rows: list[dict], name: str, metric: str) -> Sheet:
    """A block for each model, side by side with a column between."""
    down, across = name.split("_")
    sheet, column = Sheet(f"{down.title()}{across.title()}_{metric}"), 1
    for model in dict.fromkeys(r["model"] for r in rows):
        value = {(r[down], r[across]): r[metric] for r in rows if r["model"] == model}
        ups, sides = sorted({a for a, _ in value}), sorted({b for _, b in value})
        sheet.put(1, column, [model])
        sheet.put(2, column + 1, [f"{across}_{b}" for b in sides])
        for i, a in enumerate(ups, 3):
            sheet.put(i, column, [f"{down}_{a}", *[value.get((a, b)) for b in sides]])
        sheet.colour(3, column + 1, len(ups), len(sides))
        column += len(sides) + 2
    return sheet


def _details(report: EvaluationReport, models: Sequence[str]) -> Sheet:
    """Every task; rows come to the driver one partition after another."""
    sheet, wide = Sheet("Details"), report.details(models)
    sheet.put(1, 1, wide.columns)
    for i, r in enumerate(wide.toLocalIterator(), 2):
        sheet.put(i, 1, r)
    return sheet
