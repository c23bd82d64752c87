import random

from helpers import ODD, frame, sentence
from pyspark.sql import functions as F

from tokenledger.llm.line_dedup import dedup_lines, lines_deduped


def brute(rows, least=50):
    """Lines inside a run of at least ``least`` words that stands anywhere earlier."""
    lines = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, x in enumerate((t or "").split("\n")):
            x = x.translate({9: 32, 13: 32, 11: 32, 12: 32}).strip(" ")
            if x:
                lines.append((i, k, x, x.count(" ") + 1))
    first, gone = {}, {}
    for s in range(len(lines)):
        words, parts = 0, []
        for e in range(s, len(lines)):
            if lines[e][0] != lines[s][0]:
                break
            words += lines[e][3]
            parts.append(lines[e][2])
            if words >= least:
                if first.setdefault(tuple(parts), s) != s:
                    gone.setdefault(lines[s][0], set()).update(x[1] for x in lines[s : e + 1])
    for a, b in zip(lines, lines[1:]):  # blank lines between two that go
        if a[0] == b[0] and {a[1], b[1]} <= gone.get(a[0], set()):
            gone[a[0]].update(range(a[1], b[1]))
    return {i: sorted(gone.get(i, ())) for i, _ in rows}


def test_equals_brute_force(spark):
    rng = random.Random(6)
    pool = [sentence(rng, rng.choice([1, 3, 8, 20, 55])) for _ in range(14)]
    texts = ["\n".join(rng.choice([*pool, "", "  ", pool[0] + " \r"]) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    texts += ["\n".join(["Is onhe."] * 120), "\n".join(["Is onhe."] * 60), *ODD]
    rows = list(enumerate(texts))
    docs = frame(spark, rows).withColumnRenamed("lang", "removed").withColumnRenamed("source", "gone")
    want = brute(rows)
    got = dedup_lines(docs.drop("removed", "gone")).collect()
    for r in got:
        assert r.removed == want[r.doc_id], r.doc_id
        t = texts[r.doc_id]
        assert r.text == (t if not r.removed else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(r.removed)))
    out = lines_deduped(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert all((i in kept) == (not want[i] or any(x.strip() and k not in want[i] for k, x in enumerate((t or "").split("\n")))) for i, t in rows)


def test_repeated_rows_and_clashes(spark):
    long = " ".join(["w"] * 50)
    docs = frame(spark, [(1, long), (1, long), (2, long), (2, "other"), (None, None), (3, "a\n" + long + "\nb")])
    got = sorted(((r.doc_id, r.n_removed) for r in dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 1), (2, 0), (None, 0), (3, 1)], key=str)
    out = {(r.doc_id, r.text): r.n_chars for r in lines_deduped(docs).collect()}
    assert (2, long) not in out and out[(3, "a\nb")] == 3
    assert lines_deduped(docs.where("false")).count() == 0


def test_runs_of_blanks_are_no_words(spark):
    padded, tabs = "name" + " " * 60 + "value", "a" + "\t" * 80 + "b"
    many = "   ".join(f"w{k}" for k in range(50))
    texts = [f"{padded}\n{tabs}", f"{padded}\n{tabs}", many, many, f"{padded}\n{many}", f"{padded}\n" + " ".join(["x"] * 48)] + [f"{padded}\n" + " ".join(["x"] * 48)]
    got = {r.doc_id: list(r.removed) for r in dedup_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [], 1: [], 2: [], 3: [0], 4: [1], 5: [], 6: [0, 1]}


def test_a_very_long_text_ids_of_text_and_a_common_line(spark, monkeypatch):
    from tokenledger.llm import shared

    monkeypatch.setattr(shared, "HOT_SHARE", 10)  # the common line is met by broadcast
    rng = random.Random(8)
    passage = "\n".join(sentence(rng, 12) for _ in range(6))
    texts = ["\n".join(["All rights reserved.", *(sentence(rng, 9, 10**6) for _ in range(5000)), passage, "All rights reserved."])]
    texts += ["\n".join(["All rights reserved."] * 3 + [sentence(rng, 9, 10**6)] + ([passage] if k % 2 else [])) for k in range(40)]
    rows = list(enumerate(texts))
    want = {i: list(range(4, 10)) if i and i % 2 == 0 else [] for i in range(41)}  # the passage, but in the long text
    docs = frame(spark, rows).withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    assert {int(r.doc_id[1:]): list(r.removed) for r in dedup_lines(docs).collect()} == want


def test_columns_of_any_name_are_kept(spark):
    words = "\n".join(["again " * 60])
    names = ("gone", "__gone", "__gone_of", "__doc", "__made", "doc", "lo", "m")
    docs = frame(spark, [(1, words), (2, words), (3, None)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 1, 3: 0}
    assert all(r[c] == f"{c}{i}" for i, r in got.items() for c in names)
    assert lines_deduped(docs).columns == docs.columns
