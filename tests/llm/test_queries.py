"""Every registered query of the operators over one small folder of tables, against its SQL twin or a plain version."""

import glob
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_near_dedup import brute as near_classes
from test_packing import check

from tidemark.llm import bpe, mixing, queries

COMMON = "the of and to in that is was for it with as on be at by this had not are but from or have an they which one you were".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows = random.Random(11), []
    text = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"w{rng.randrange(700)}" for _ in range(n))
    passage = text(40)
    for i in range(80):
        body = text(rng.randint(3, 120))
        rows.append((2 * i, f"{body}\n{passage}" if i % 6 == 0 else body, f"s{i % 5}"))
        if i % 7 == 0:
            rows.append((2 * i + 1, rows[-1][1].replace(" ", "  "), "s1"))
        if i % 9 == 0:
            rows.append((1000 + i, rows[-1][1] + " end", "s2"))
    rows += [(2001, None, "s0"), (2002, "", None), (2003, " \n\t ", "s1"), (2004, "### $$$ " * 30, "s2"), (2005, "a b c d e " * 20, "s3"), (2006, "é ñ 𝄞 " * 20, None)]
    rows += [(2007, text(9000), "s4"), (2008, "mail a.b@c.de from 10.0.0.300 or 8.8.8.8, call +1 (555) 555-0123, pay 4111 1111 1111 1111", "s0")]
    pages = [(i, f"http://h/{i}", f"<p>{i % 9}</p>\n" * (i % 4)) for i in range(50)] + [(60, None, None), (61, "u", "ß𝄞" * 1000)]
    out = str(tmp_path_factory.mktemp("tables"))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out, rows


def run(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({glob.glob(f'{tables[0]}/{table}.parquet/*.parquet')})")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = Counter(tuple(zip(names, r)) for r in found.fetchall())
    assert want and Counter(tuple((c, r[c]) for c in names) for r in run(spark, tables, name)) == want


def test_op1_base_and_score(spark, tables):
    rows = tables[1]
    words = lambda t: [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not out(i) for w in words(t))
    total = sum(c.values())
    got = {r["doc_id"]: r for r in run(spark, tables, "op1_lm_scoring")}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, w = got[i], words(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(c[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w)) and math.isfinite(r["score"]) and r["score"] < 0


def test_op4_and_op5_cover_every_token(spark, tables):
    coder = bpe.Bpe(*bpe.default_paths())
    lengths = {i: len(coder.whole.encode(t or "", add_special_tokens=False).ids) for i, t, _ in tables[1]}
    histogram = {r["length"]: r["n_docs"] for r in run(spark, tables, "op4_token_counts")}
    assert histogram == Counter(lengths.values())
    got, own = run(spark, tables, "op5_best_fit_packing"), defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
    for i, n in lengths.items():
        mine = sorted(own[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in mine) == n + 1 and [r["piece"] for r in mine] == list(range(len(mine))) and len(mine) == max(1, -(-(n + 1) // 2048))
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
    # Another packer, first fit by falling length, needs no fewer sequences.
    rooms: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        at = next((j for j, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(2048)
            at = len(rooms) - 1
        rooms[at] -= n
    assert -(-sum(r["length"] for r in got) // 2048) <= check(got, 2048) <= len(rooms)


def test_op7_classes_match_brute_force(spark, tables):
    rows, groups = tables[1], defaultdict(list)
    for r in run(spark, tables, "op7_minhash_near_dedup"):
        groups[r["class_id"]].append(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert sorted(sorted(g) for g in groups.values()) == near_classes([r[0] for r in rows], [r[1] for r in rows])


def test_op8_targets_and_taken(spark, tables):
    rows, got = {i: (t, s) for i, t, s in tables[1]}, run(spark, tables, "op8_mixing")
    size, taken, longest = Counter(), Counter(), Counter()
    for r in got:
        text, source = rows[r["doc_id"]]
        assert r["size"] == len(WORD.findall(text or "")) and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        size[source] += r["size"]
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
    names = [*sorted(s for s in size if s), None]
    target = dict(zip(names, mixing.targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))])))
    for r in got:
        source = rows[r["doc_id"]][1]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(target[source])
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-9 for s in names)
    again = {r["doc_id"]: r["taken"] for r in run(spark, tables, "op8_mixing")}
    assert again == {r["doc_id"]: r["taken"] for r in got}
