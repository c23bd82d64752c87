"""Operator 10: line dedup by a suffix array over line-ID sequences, by DataFrame functions only.

A text's lines, trimmed, without blank ones, are a sequence of line IDs. The suffixes of all
sequences are sorted by distributed prefix doubling: level 0 ranks them by their first line, and
level k + 1 ranks the pairs (rank at i, rank at i + 2^k), so ranks of level k order suffixes by their
first 2^k lines. Ranks come from one range-partitioned sort of the distinct pairs. A suffix that
shares its first 2^k lines with no other is told apart and leaves; what remains is the part of the
suffix array whose neighbours have a common prefix of 2^k lines at least. Doubling stops when no
suffix remains or the length is enough.

A repeat counts from ``min_words`` words on. Each position gives two shortest runs that reach them:
the one that begins there and the one that ends there. The suffixes whose longest common prefix
holds a run of m lines are an interval of the suffix array; with 2^k <= m < 2^(k+1), two suffixes lie
in one interval if they have equal ranks of level k at the run's first line and at 2^k lines before
its end (two overlapping pieces that cover it). The first occurrence in an interval, by id and then
position, stays, and the lines of later ones are deleted. A maximal repeated run is the union of the
shortest runs in it, so exactly the lines inside a repeat of at least ``min_words`` words go.

Lines, pairs and runs that very many suffixes share meet their ranks by broadcast, see ``join_hot``.

Defined results: a null text stays null, an empty one empty; a copy inside the same text counts as
later; rows of the same id and text are one document to the repeats and get the same result; texts
under one id are ordered by their hash; a null id comes first; ids are of any type that has an order;
extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, join_hot, unused, written

MIN_WORDS = 50


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def _single(line: Column) -> Column:
    """The line with one blank between words: words are the parts that are not empty."""
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line)


def _document(doc_id: str, text: str) -> Column:
    """What tells a document, and orders it: its id, and the hash of its text."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("key"))


def text_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each line that is not blank: doc, p (its number among them), w (words), a, b (its ID)."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), _trimmed), lambda x: x != "")
    return (
        docs.where(F.col(text).isNotNull())
        .select(_document(doc_id, text).alias("doc"), F.posexplode(lines).alias("p", "line"))
        .select(
            "doc",
            "p",
            (F.length(_single(F.col("line"))) - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("w"),
            F.xxhash64(F.lit(0), "line").alias("a"),
            F.xxhash64(F.lit(1), "line").alias("b"),
        )
    )


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose values of ``by`` occur more than once, with r: the rank of these values among all such."""
    several = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    # numbers that rise over the partitions of a sort are ranks; written, they stay what they are
    ranks = written(several.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return join_hot(rows, ranks, by, "n", rows.count())


def repeated_positions(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """The suffixes of level 0, those whose first line occurs elsewhere: doc, p, r, and the lengths
    ``ahead`` and ``back`` of the shortest runs of ``min_words`` words from and up to the line (null if there is none)."""
    lines = written(text_lines(docs, doc_id, text), "lines")
    met = _ranked(lines, ["a", "b"]).select("doc", "p", F.col("w").cast("long").alias("w"), F.col("rank").alias("r"))
    # repeated rows are one document
    rows = met.repartition("doc").dropDuplicates(["doc", "p"])
    # a stretch of lines that all occur elsewhere; a repeated run lies in one
    rows = rows.withColumn("stretch", F.col("p") - F.row_number().over(W.partitionBy("doc").orderBy("p")))
    stretch = W.partitionBy("doc", "stretch")
    rows = rows.withColumn("upto", F.sum("w").over(stretch.orderBy("p"))).withColumn("before", F.col("upto") - F.col("w"))
    # a run that begins here goes on as long as a line begins within min_words - 1 words; mirrored for one that ends here
    ahead = stretch.orderBy("before").rangeBetween(W.currentRow, min_words - 1)
    back = stretch.orderBy("upto").rangeBetween(1 - min_words, W.currentRow)
    length = lambda w: F.when(F.sum("w").over(w) >= min_words, F.count("*").over(w).cast("int"))
    return written(rows.select("doc", "p", "r", length(ahead).alias("ahead"), length(back).alias("back")), "suffixes")


def repeated_runs(suffixes: DataFrame) -> DataFrame:
    """Runs (doc, lo, m) whose m lines occur more than once, with the ranks (ra, rb) that name their interval."""
    of = lambda lo, m: F.struct(lo.cast("int").alias("lo"), F.col(m).alias("m"))
    both = F.explode(F.array(of(F.col("p"), "ahead"), of(F.col("p") - F.col("back") + 1, "back")))
    runs = written(suffixes.select("doc", both.alias("run")).where("run.m IS NOT NULL").select("doc", "run.*").distinct(), "runs")
    most = runs.agg(F.max("m")).first()[0] or 0
    ranks, size, out = suffixes.select("doc", "p", "r"), 1, []
    while size <= most:
        todo = runs.where(f"m >= {size} AND m < {2 * size}").withColumn("end", F.col("lo") + F.col("m") - size)
        first = ranks.select("doc", F.col("p").alias("lo"), F.col("r").alias("ra"))
        last = ranks.select("doc", F.col("p").alias("end"), F.col("r").alias("rb"))
        out.append(written(todo.join(first, ["doc", "lo"]).join(last, ["doc", "end"]).select("doc", "lo", "m", "ra", "rb"), "named"))
        size *= 2
        if size > most:
            break
        behind = W.partitionBy("doc").orderBy("p").rangeBetween(size // 2, size // 2)
        pairs = written(ranks.withColumn("next", F.max("r").over(behind)).where("next IS NOT NULL"), "pairs")
        ranks = written(_ranked(pairs, ["r", "next"]).select("doc", "p", F.col("rank").alias("r")), "suffixes")
        if not ranks.take(1):  # all told apart
            break
    named = suffixes.sparkSession.createDataFrame([], runs.withColumns({"ra": F.lit(0).cast("long"), "rb": F.lit(0).cast("long")}).schema)
    for part in out:
        named = named.unionByName(part)
    return named


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, gone): for documents that have any, the lines that are later copies, by their sorted numbers among those that are not blank."""
    runs = written(repeated_runs(repeated_positions(docs, doc_id, text, min_words)), "runs")
    place = F.struct("doc", "lo")
    intervals = written(runs.groupBy("m", "ra", "rb").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "intervals")
    later = join_hot(runs, intervals, ["m", "ra", "rb"], "n", runs.count()).where(place > F.col("first"))
    by_doc = later.groupBy("doc").agg(F.collect_set(F.struct("lo", "m")).alias("runs"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["lo"] + r["m"] - 1)))))
    return written(by_doc.select("doc", gone.alias("gone")), "gone")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_removed, removed (indexes of deleted lines) and text without them.

    A blank line goes if the lines before and behind it go. Deletions of up to ``BROADCAST_ROWS`` rows
    and eight times as many lines are broadcast; more of them meet their texts by a shuffle.
    """
    lost, owner, own, made = (unused(docs, c) for c in ("__gone", "__gone_of", "__doc", "__made"))
    gone = repeated_lines(docs, doc_id, text, min_words).withColumnsRenamed({"doc": owner, "gone": lost})
    told = gone.agg(F.count("*"), F.coalesce(F.sum(F.size(lost)), F.lit(0))).first()
    small = told[0] <= BROADCAST_ROWS and told[1] <= 8 * BROADCAST_ROWS
    keyed = docs.withColumn(own, F.when(F.col(text).isNotNull(), _document(doc_id, text)))
    met = keyed.join(F.broadcast(gone) if small else gone.hint("shuffle_hash"), F.col(own) == F.col(owner), "left").drop(own, owner)
    none = F.array().cast("array<int>")

    def rebuilt(raw: Column) -> Column:
        """Everything about one text, each part bound once: what refers to it inside a lambda finds it ready."""
        full = F.filter(F.transform(raw, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
        return _let(full, lambda f: _let(F.when(F.col(lost).isNull(), none).otherwise(F.flatten(spans(f))), lambda cut: kept(raw, cut)))

    def spans(full: Column) -> Column:
        """From each deleted line up to the next one, if no line that stays is between."""
        at = lambda k: F.get(full, F.get(F.col(lost), k))
        joined = lambda k: F.get(F.col(lost), k + 1) == F.get(F.col(lost), k) + 1
        return F.transform(lost, lambda _, k: F.sequence(at(k), F.when(joined(k), at(k + 1) - 1).otherwise(at(k))))

    def kept(raw: Column, cut: Column) -> Column:
        """What stays, piece by piece: from behind a deleted line up to the next one."""
        edges = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(raw)))
        piece = lambda e, k: F.slice(raw, F.get(e, k) + 2, F.get(e, k + 1) - F.get(e, k) - 1)
        pieces = _let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: piece(e, k))))
        new = F.when(F.size(cut) > 0, F.array_join(pieces, "\n"))
        return F.struct(F.size(raw).cast("long").alias("lines"), cut.alias("removed"), new.alias("text"))

    met = met.withColumn(made, _let(F.split(F.col(text), "\n", -1), rebuilt))
    return met.withColumns(
        {
            "removed": F.coalesce(f"{made}.removed", none),
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.col(f"{made}.lines")).cast("long"),
            "n_removed": F.coalesce(F.size(f"{made}.removed"), F.lit(0)).cast("long"),
            text: F.coalesce(f"{made}.text", text),
        }
    ).drop(lost, made)


def lines_deduped(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, texts without later copies and n_chars, if it is there, to match; a
    document of which nothing is left goes."""
    out = dedup_lines(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), "doc_id", "text"))
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("__row.n_chars")).alias(c)
        return F.col(f"__row.{c}")

    return out.select(*[column(c) for c in docs.columns])


def lines_digest(out: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return out.select(
        doc_id,
        "n_lines",
        "n_removed",
        F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
    )


#: The same by plain runs of lines, compared as texts. It orders equal ids by nothing: ids are distinct in the tables it is for.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
r AS (SELECT doc_id, i, trim(translate(raw[i + 1], chr(9) || chr(13) || chr(11) || chr(12), '    ')) AS t FROM (SELECT doc_id, raw, unnest(range(len(raw))) AS i FROM d)),
l AS (SELECT doc_id, i, t, len(regexp_replace(t, ' +', ' ', 'g')) - len(replace(t, ' ', '')) + 1 AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE t <> ''),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM l),
f AS (SELECT x.doc_id, x.p AS lo, min(y.p) AS hi FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.p BETWEEN x.p AND x.p + {MIN_WORDS - 1} AND y.c - x.c + x.w >= {MIN_WORDS} GROUP BY ALL),
g AS (SELECT y.doc_id, max(x.p) AS lo, y.p AS hi FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.p BETWEEN y.p - {MIN_WORDS - 1} AND y.p AND y.c - x.c + x.w >= {MIN_WORDS} GROUP BY y.doc_id, y.p),
u AS (SELECT * FROM f UNION SELECT * FROM g),
t AS (SELECT u.doc_id, u.lo, u.hi, string_agg(s.t, chr(10) ORDER BY s.p) AS t FROM u JOIN s ON s.doc_id = u.doc_id AND s.p BETWEEN u.lo AND u.hi GROUP BY ALL),
o AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY t ORDER BY doc_id, lo) AS k FROM t),
x AS (SELECT DISTINCT l.doc_id, l.p, l.i FROM o JOIN l ON l.doc_id = o.doc_id AND l.p BETWEEN o.lo AND o.hi WHERE k > 1),
z AS (SELECT doc_id, i FROM x UNION SELECT r.doc_id, r.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN r ON r.doc_id = a.doc_id AND r.i > a.i AND r.i < b.i),
q AS (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed FROM z GROUP BY doc_id),
v AS (SELECT r.doc_id, string_agg(d.raw[r.i + 1], chr(10) ORDER BY r.i) AS t FROM r JOIN d ON d.doc_id = r.doc_id LEFT JOIN z ON z.doc_id = r.doc_id AND z.i = r.i WHERE z.i IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(v.t, '')) AS text_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id
"""
