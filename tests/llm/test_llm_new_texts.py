"""Fill-in-the-middle, repeated lines and phrase collocations against plain Python."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surcos.llm import infill, lines, phrases
from surcos.llm.queries import QUERIES
from surcos.llm.shipping import ship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
SCHEMA = "doc_id long, text string, lang string, n long, form string, k long, run string, pos int, line string, id long"
BLANK = " \t\n\x0b\x0c\r"


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def awkward():
    prose = "The quick brown fox.\nshared line of some length\n  Shared LINE of some length \r\nÉtude über alles"
    texts = [
        None, "", "\n", "\n\n", " \t\n ", "a", prose, prose, prose.upper(), "<P> marked", "x<S>", "<M", "shared line of some length",
        "ÀÉ shared line of some length", "no break   space", "🙂🙃\n" * 30, "Z" * 60_000, " " * 5000, "a b " * 20_000,
        "\n".join(f"row {k % 50} of the long table" for k in range(4000)), "tab\tline one two\n" * 3,
    ]
    rest = (1, "f", 2, "r", 3, "l", 4)  # columns whose names the operators use inside
    rows = [(k, t, ("en", None, "und", "de")[k % 4], *rest) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (6, "same id, other text of a line", "en", *rest), (None, prose, "en", *rest), (None, None, None, *[None] * 7)]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is not None, str(v)) for v in r])


# Fill-in-the-middle


def moved(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_python_and_restores(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = infill.infill(both).select("doc.*", "n", "form", "prefix_chars", "middle_chars", "output", infill.restored().alias("back")).collect()
    expected = [moved(r["doc_id"], r["text"]) for r in both.collect()]
    assert ordered((r["doc_id"], *r[2:7]) for r in got) == ordered(expected)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_keeps_clashing_columns_and_handles_no_rows(odd, empty):
    out = infill.infill(odd)
    assert out.select("doc.*").columns == odd.columns
    assert ordered(out.select("doc.*").collect()) == ordered(odd.collect())
    assert infill.infill(empty).collect() == []


def test_infill_restores_texts_made_of_marker_parts(spark):
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choice("<>PSM a") for _ in range(rnd.randrange(40)))) for k in range(400)]
    got = infill.infill(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=0)
    assert all(r["t"] == r["back"] for r in got.select(F.col("doc.text").alias("t"), infill.restored().alias("back")).collect())


@pytest.mark.parametrize("text", ["ab1cd  efg" * 50, "x" * 500, "1" * 500, "a" * 333 + "-" + "b" * 200])
def test_long_texts_in_stretches_give_the_same_ends(text):
    whole = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    assert list(infill.unit_ends(text)) == whole
    assert all(list(infill.unit_ends(text, n)) == whole for n in (1, 2, 7, 64, 499))


def test_very_long_text_has_all_its_tokens():
    text = "ab cd " * 700_000 + "\n" * 1_000_000
    assert len(infill.unit_ends(text)) == 4 * 700_000 + 1_000_000


# Repeated lines


def without_repeats(rows, least=10):
    """(n_lines, n_dropped, kept) of every (id, text)."""
    order = lambda i: (i is None, i or 0)
    key = lambda line: small(line.strip(BLANK))
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, text in rows:
        each = (text or "").split("\n")
        stay = [x for x in each if len(key(x)) < least or first[key(x)] == order(i)]
        out.append((i, len(each), len(each) - len(stay), "\n".join(stay)))
    return out


def deduped(df):
    kept = lines.apply_bitmaps(df, lines.keep_bitmaps(df))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()


def test_line_dedup_equals_plain_python(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 50).alias("doc_id"), "text"))
    assert ordered(deduped(both)) == ordered(without_repeats([tuple(r) for r in both.collect()]))


def test_line_dedup_with_a_line_in_a_third_of_all_rows(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(600):
        own = [f"line number {rnd.randrange(900)} of many" for _ in range(3)] + ["short"] * 2
        rows.append((None if k % 97 == 5 else rnd.randrange(500), "\n".join(own + ["The One Common Line"] * (5 * (k % 3 == 0)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hot = lines.hot_keys(lines.occurrences(df), "h1")
    assert len(hot) == 1
    assert ordered(deduped(df)) == ordered(without_repeats(rows))


def test_bitmaps_are_runs_and_hold_no_text(spark):
    rows = [(1, "aaaaaaaaaa\nbbbbbbbbbb\ncccccccccc"), (2, "aaaaaaaaaa\nbbbbbbbbbb\nx\n CCCCCCCCCC\t\ny"), (3, "nothing repeated")]
    got = lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["id", "row", "n_dropped", "dropped_runs"]
    assert [(r["id"], r["n_dropped"], [tuple(x) for x in r["dropped_runs"]]) for r in got.collect()] == [(2, 3, [(0, 2), (3, 1)])]


def test_line_dedup_keeps_clashing_columns_and_handles_no_rows(odd, empty):
    kept = lines.apply_bitmaps(odd, lines.keep_bitmaps(odd))
    assert ordered(kept.select("doc.*").collect()) == ordered(odd.collect())
    assert deduped(empty) == []


def test_lines_are_shuffled_once_by_range(spark):
    df = spark.createDataFrame([(k, f"a line of document {k}\nand one of group {k // 2}") for k in range(40)], "doc_id long, text string")
    plan = lines.dropped(lines.occurrences(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert plan.count("Sort [") == 1 and "Python" not in plan


# Phrases


def collocated(rows, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    enough = {g: n for g, n in counts.items() if n >= least and len(g[1]) > 1}
    inside = set()
    for (lang, w), n in enough.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = lang, w[i : i + size]
                if 100 * n >= 100 * enough[part]:
                    inside.add(part)
    out = []
    for lang in total:
        n, scored = total[lang], []
        for (g, w), a in enough.items():
            if g != lang or (g, w) in inside:
                continue
            cuts = [(counts[g, w[:k]], counts[g, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


def test_texts_are_cut_into_words_a_part_at_a_time():
    texts = ["some words of a text " * 500] * 400
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 400)], ["text", "lang"])
    parts = [len(w.letters) for w in phrases._read([batch])]
    assert sum(parts) == sum(len("".join(t.split())) for t in texts) and max(parts) <= phrases.PART


@pytest.mark.parametrize("bits", [phrases.SLOT_BITS, 15, 3])
def test_collocations_equal_plain_python_however_few_slots(spark, docs, odd, bits):
    both = docs.select("text", "lang").unionByName(odd.select("text", "lang"))
    got = phrases.collocations(both, least=12, top=150, bits=bits).collect()
    assert ordered(got) == ordered(collocated([(r["lang"], r["text"]) for r in both.collect()], 12, 150))
    assert len(got) > 250


def test_runs_cross_chunks(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(("a ", "b ", "c ", "a b c d ", "\tA", ". ")) for _ in range(300)) for _ in range(40)]
    words = phrases.Words(pa.array(texts), pa.array(["en"] * 40))
    whole = [next(iter(words.chunks(1 << 20)))]
    codes, spelled, piece, _, own = whole[0]
    flat = [spelled[int(c)].as_py() for c in codes]
    for size in (1, 2, 5, 13):
        joined = []
        for codes, spelled, part, _, own in words.chunks(size):
            joined += [spelled[int(c)].as_py() for c in codes[:own]]
            assert len(codes) == min(own + 4, len(flat) - len(joined) + own)
        assert joined == flat


def test_scores_are_exact_beyond_64_bits(spark):
    # Counts near those of a corpus of 10^13 words: 1000 a n has 29 digits.
    rows = [("und", "p q", 2, 4_000_000_000_001), ("und", "p", 1, 4_000_000_000_003), ("und", "q", 1, 4_000_000_000_007)]
    n = 9_000_000_000_011
    p, t = spark.createDataFrame(rows, "lang string, phrase string, k int, f long"), spark.createDataFrame([("und", n)], "lang string, n long")
    got = phrases.ranked(p, t, top=5).collect()
    assert [tuple(r) for r in got] == [
        ("und", 1, "p q", rows[0][3], rows[1][3], rows[2][3], n, 1000 * rows[0][3] * n // (rows[1][3] * rows[2][3]))
    ]


def test_no_phrases_of_no_texts(spark, odd, empty):
    assert phrases.collocations(empty).collect() == []
    nothing = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " .,;\t\n", "de")], "doc_id long, text string, lang string")
    assert phrases.collocations(nothing, least=1).collect() == []


def test_ties_go_by_count_then_phrase(spark):
    rows = [("en", "b c. " * 4 + "a d. " * 4 + "e f. " * 2), ("fr", "b c. " * 2)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=2).collect()
    assert [(r["lang"], r["rank"], r["phrase"]) for r in sorted(got)] == [("en", 1, "e f"), ("en", 2, "a d"), ("en", 3, "b c"), ("fr", 1, "b c")]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_line_dedup", "op13_phrase_collocations"])
def test_queries_return_their_columns(spark, name):
    df = QUERIES[name](spark, SF)
    wanted = {
        "op11": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        "op13": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    }[name[:4]]
    assert df.columns == wanted
