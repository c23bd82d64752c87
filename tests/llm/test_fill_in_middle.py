import hashlib
import random
import re

import duckdb
from helpers import DOCS, ODD, frame
from pyspark.sql import functions as F

from tokenledger.llm import fill_in_middle as m


def by_hand(key, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(3)
    odd = ["\n", "a\n", "\na", "a\r\nb\r\n", "<P>", "x\n<M>\n", "<\nP>\n<S", "x<\n<P\nM>\n", "é\n中\n😀\n" * 3000, "y" * 50_000 + "\nz", "<S\n<P\n<M\n" * 5, " a\x0bb\x0c\n"]
    lines = ["".join(rng.choice("ab é中😀<>PSM\r") for _ in range(rng.choice((0, 1, 5, 40, 5000)))) for _ in range(300)]
    made = ["".join(line + ("\n" if rng.random() < 0.9 else "") for line in rng.sample(lines, rng.randrange(1, 12))) for _ in range(150)]
    return ODD + odd + made


def test_outputs_equal_slices_of_the_units(spark):
    docs = [(k, t) for k, t in enumerate(texts())] + [(None, "a\nb\nc"), (5, "again\nand again\n"), (5, "again\nand again\n")]
    for rate, spm, seed in ((100, 50, 7), (60, 20, 9)):
        got = m.transformed(frame(spark, docs), rate=rate, spm=spm, seed=seed).withColumn("back", m.restored(F.col("output"), F.col("form"))).collect()
        want = sorted((str(k), *map(str, by_hand(k, t, rate, spm, seed))) for k, t in docs)
        assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == want
        assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_places_in_small_blocks():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("a\né😀") for _ in range(rng.randrange(60)))
        index = m.LineIndex(text.encode(), block=rng.choice((1, 3, 4, 7, 100)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert index.units == len(units)
        assert [index.place(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_digest_equals_sql(spark):
    docs = [(k, t) for k, t in enumerate(texts()) if "\x00" not in (t or "")]
    pdf = frame(spark, docs).toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    want = sorted(tuple(map(str, r)) for r in con.execute(m.ORACLE).fetchall())
    got = m.transformed_digest(m.transformed(frame(spark, docs)))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == want


def test_clashing_columns_and_an_empty_table(spark):
    rows = frame(spark, [(1, "a\nb")]).withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2), "first": F.lit(3), "prefix_chars": F.lit("p")})
    r = m.transformed(rows).first()
    assert (r.n, r["first"], r.lang) == (2, 3, "en") and r.output == by_hand(1, "a\nb")[4]
    assert m.transformed_digest(m.transformed(spark.createDataFrame([], DOCS))).count() == 0
