import re

from pyspark.sql import functions as F

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, windows = {}, [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e", "x\ny\nx\n x\n\n\n#|<>*", "der die ñ é 𝄞 a b " * 7,
    "the cat\x0b sat\x0c on the mat " * 3, "the of and to in that is was for it with as his on be " + "w" * 50000, " ".join(f"w{i % 97}" for i in range(3000)),
]


def test_metrics_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "doc_id long, text string, quality__ string")
    judged, name = quality.verdicts(docs)
    got = {r[0]: tuple(r)[1:] for r in judged.select("doc_id", *[F.col(name)[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_verdicts_on_samples(spark):
    good = "the quick fox is in the house and it was not far from the river where they had found it with his dog on a day in may"
    rows = [(1, good), (2, good.upper() + "!!"), (3, " ".join(w + "###" for w in good.split())), (4, "x y"), (5, None), (5, None)]
    judged, name = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string"))
    broken = {r[0]: set(r[1]) for r in judged.select("doc_id", F.col(name)["broken"]).collect()}
    assert broken[1] == set() and "shouting" in broken[2] and "symbols" in broken[3] and "few_words" in broken[4] and "few_words" in broken[5]
    assert quality.keep_good(spark.createDataFrame([], "doc_id long, text string")).count() == 0
