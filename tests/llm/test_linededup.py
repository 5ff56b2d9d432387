"""Aligned blocks are common and in order; the later document loses them, and nothing else."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import linededup as D

LINES = st.lists(st.integers(0, 12), max_size=25)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_blocks(x, y):
    found = D.common_blocks(x, y)
    i0 = j0 = 0
    for i, j, n in found:
        assert i >= i0 and j >= j0 and n > 0 and x[i : i + n] == y[j : j + n]
        i0, j0 = i + n, j + n
    once = [v for v in x if x.count(v) == 1 and y.count(v) == 1]
    if once and [v for v in y if v in once] == once:  # unique lines in one order are all kept
        aligned = [v for i, _, n in found for v in x[i : i + n]]
        assert set(once) <= set(aligned)
    assert D.common_blocks(x, x) == ([(0, 0, len(x))] if x else [])


def passage(k, n=30):
    return "\n".join(f"passage {k} line {i} with quite a few words in it" for i in range(n // 10))


def test_planted(spark):
    """Passages that several documents share; hundreds of holders of one; short common lines stay."""
    own = lambda i: f"document {i} begins\nshort line\nits own text number {i} which nobody else has at all"
    rows = [(i, own(i) + "\n" + passage(0) + f"\nend {i}") for i in range(300)]
    rows += [(1000, own(1000) + "\n" + passage(1)), (1001, passage(1) + "\n" + own(1001) + "\n" + passage(2)), (1002, own(1002) + "\n" + passage(2) + "\nlast")]
    out = {r["doc_id"]: r for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    for i in range(1, 300):
        assert out[i]["text"] == own(i) + f"\nend {i}" and out[i]["words_removed"] == 33 and out[i]["n_removed"] == 3
    assert out[1000]["n_removed"] == 0 and out[1001]["text"] == own(1001) + "\n" + passage(2) and out[1002]["text"] == own(1002) + "\nlast"


def test_small_table(small):
    """What goes stands, line for line, in an earlier document; all else stays."""
    before = {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
    lines = {i: [x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")] for i, t in before.items()}
    held: dict = {}
    for i, ls in lines.items():
        for x in ls:
            held[x] = min(i, held.get(x, i))
    n = 0
    for r in D.dedup_lines(small).collect():
        i, t = r["doc_id"], before[r["doc_id"]]
        if r["n_removed"] == 0:
            assert r["text"] == t
            continue
        left = [x.strip(" \t\n\v\f\r") for x in r["text"].split("\n")]
        gone = list(lines[i])
        for x in left:
            if x in gone:
                gone.remove(x)
        assert all(held[x] < i for x in gone if x)
        n += 1
    assert n > 0


def test_edges(spark, edges, nothing):
    out = D.dedup_lines(edges)
    assert out.count() == edges.count() and out.columns == [*edges.columns, "n_lines", "n_removed", "words_removed"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == "   \n\t " and by[None]["text"] == "no id here at all" and by[1]["n_lines"] == 0
    assert D.dedup_lines(nothing).count() == 0
    same = passage(7)
    copies = spark.createDataFrame([(i, same, "clash") for i in range(5)], "doc_id long, text string, n_lines string")
    assert sorted((r["doc_id"], r["text"] == same, r["text"] == "") for r in D.dedup_lines(copies).collect()) == [(0, True, False), *((i, False, True) for i in range(1, 5))]


def test_short_lines(spark):
    """A passage laid out in short lines goes from all but the first of its holders, however many
    they are; so do whole documents of short lines."""
    verse = "\n".join(f"verse {i} of a few words" for i in range(9))
    rows = [(i, f"own beginning {i}\n{verse}\nown end {i}") for i in range(6)] + [(10 + i, "\n".join(f"entry {j} of list" for j in range(8))) for i in range(5)]
    out = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and out[10] == rows[6][1]
    assert all(out[i] == f"own beginning {i}\nown end {i}" for i in range(1, 6)) and all(out[i] == "" for i in range(11, 15))


def test_scattered_lines(spark):
    """The lines of a block have other earliest holders than the block itself."""
    one, two = "first line of the block that has eleven words in it", "second line of the block that has just as many words"
    rows = [(1, f"a\n{one}\nb"), (2, f"c\n{two}\nd"), (3, f"e\n{one}\n{two}\nf"), (4, f"g\n{one}\n{two}\nh")]
    out = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**dict(rows[:3]), 4: "g\nh"}


def test_against_all_runs(spark):
    """A line goes if it lies in a run of 20 words or more that an earlier document has anywhere:
    repeated in either, moved, or with nothing unique about it."""
    rng = random.Random(3)
    line = [" ".join([f"l{i}"] * n) for i, n in enumerate([1, 2, 3, 5, 7, 8, 11, 19, 20, 30])]
    docs = {i: [rng.choice(line) for _ in range(rng.randint(0, 14))] for i in range(60)}
    block = [f"{i} of ten words in a line of the passage" for i in range(6)]
    docs |= {100: ["a", *block, "b"], 101: ["c", *block, "d", *block, "e"], 102: [*block[3:], *block[:3]]}
    rows = [(i, "\n".join(x)) for i, x in docs.items()]
    runs: set = set()
    want = {}
    for i, x in docs.items():
        spans = [(a, z) for a in range(len(x)) for z in range(a + 1, len(x) + 1) if len(" ".join(x[a:z]).split()) >= 20]
        gone = {n for a, z in spans if tuple(x[a:z]) in runs for n in range(a, z)}
        want[i] = "\n".join(v for n, v in enumerate(x) if n not in gone)
        runs |= {tuple(x[a:z]) for a, z in spans}
    out = {r["doc_id"]: r["text"] for r in D.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == want and out[101] == "c\nd\ne" and out[102] == ""
