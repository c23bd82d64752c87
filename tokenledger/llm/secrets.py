"""Operator 6: secret scans, by DataFrame functions only.

Base kinds are patterns (``BASE``). The method adds candidate strings whose Shannon entropy, over a
window sliding along the string, reaches the threshold of their character class. The window's
counts are kept up incrementally: a step takes one character out and one in, and the sum of
c * log2(c) changes by those two counts only; it is held in millionths, so equal windows give equal
sums on any engine. Candidates that the allow-list names are suppressed; base spans never are.

Offsets are code points. They come from the matches and the gaps between them (one ``split``), by
prefix sums over the lengths, so no row-wise code is needed.

A candidate needs a letter and a digit; a match of the allow-list anywhere in it suppresses it whole.

Defined results: a null or empty text has no spans; repeated rows each get their own; extra columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length. Fixed values.
BASE = (
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Character classes, first match wins: a candidate's class and the bits per character it must reach.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^(?:[0-9a-z+/=_-]+|[0-9A-Z+/=_-]+)$", 3.6),
    (r"", 3.7),
)
#: Candidates that are no secrets: identifiers in the form of UUIDs, fill-in values, plain sequences.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i:example|placeholder|changeme|dummy|sample|your[_-])",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)
#: Lengths summed at a time when offsets are made.
_BLOCK = 64


def _weights(window: int) -> list[int]:
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def most_sum(bits: float, window: int) -> int:
    """The largest sum of c * log2(c) a window may have at ``bits`` per character, in millionths."""
    return math.floor((math.log2(window) - bits) * window * 1e6)


def _offsets(gaps: Column, found: Column) -> Column:
    """Where each match starts: all gaps up to it and all matches before it."""
    total = lambda a, lo, n: F.aggregate(F.slice(a, lo, n), F.lit(0), lambda s, x: s + x)
    steps = F.transform(gaps, lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)))
    blocks = lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: total(s, F.lit(1), b * _BLOCK)
    )
    return F.transform(
        F.array(F.struct(steps.alias("s"))),
        lambda a: F.transform(
            F.array(F.struct(a["s"].alias("s"), blocks(a["s"]).alias("b"))),
            lambda x: F.transform(
                F.slice(x["s"], 1, F.size(found)),
                lambda _, i: F.get(x["b"], F.floor(i / _BLOCK).cast("int"))
                + total(x["s"], F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1),
            ),
        )[0],
    )[0]


def _entropy_sum(value: Column, window: int) -> Column:
    """The least sum of c * log2(c) over the windows of ``value``, by incremental counts; the work grows with the length alone."""
    weights = F.array(*[F.lit(x) for x in _weights(window)])

    def step(s: Column, move: Column) -> Column:
        char_in, char_out = move["i"], move["o"]
        c_out = F.when(char_out > 0, F.get(s["counts"], char_out)).otherwise(F.lit(0))
        c_in = F.get(s["counts"], char_in) - F.when(char_in == char_out, 1).otherwise(0)
        less = F.when(c_out > 0, F.get(weights, c_out) - F.get(weights, c_out - 1)).otherwise(F.lit(0))
        total = s["total"] - less + F.get(weights, c_in + 1) - F.get(weights, c_in)
        counts = F.transform(
            s["counts"],
            lambda c, k: F.when(k == 0, c).otherwise(
                c + F.when(k == char_in, 1).otherwise(0) - F.when(k == char_out, 1).otherwise(0)
            ),
        )
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(move["full"] & (total < s["least"]), total).otherwise(s["least"]).alias("least"),
        )

    def summed(chars: Column) -> Column:
        out = lambda i: F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(0))
        moves = F.transform(chars, lambda c, i: F.struct(c.alias("i"), out(i).alias("o"), (i + 1 >= window).alias("full")))
        none = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
        start = F.struct(none.alias("counts"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least"))
        return F.aggregate(moves, start, step, lambda s: s["least"])

    # the characters' places in the alphabet, found once
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.get(F.transform(F.array(places), summed), F.lit(0))


def _spans(found: Column, starts: Column, number: int, keep) -> Column:
    made = F.transform(
        found,
        lambda m, i: F.struct(
            F.get(starts, i).alias("start"),
            F.lit(number).alias("number"),
            (F.get(starts, i) + F.length(m)).alias("end"),
            m.alias("value"),
        ),
    )
    return F.filter(made, lambda x: keep(x["value"]))


def secret_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with secrets: array of (start, number, end, value), ordered; ``kinds()[number]`` names the kind."""
    kinds = [(p, (lambda v, p=p, g=g, n=n: F.length(F.regexp_extract(v, p, g)) >= n)) for _, p, g, n in BASE]

    def dense(v: Column) -> Column:
        ok = F.lit(False)
        for pattern, bits in reversed(CLASSES):
            ok = F.when(v.rlike(pattern), _entropy_sum(v, window) <= most_sum(bits, window)).otherwise(ok)
        mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
        allowed = F.lit(False)
        for a in allow:
            allowed = allowed | v.rlike(a)
        return F.when(mixed & ~allowed, ok).otherwise(F.lit(False))

    kinds.append((CANDIDATE, dense))
    out = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    names = range(len(kinds))
    # each step is a column that the next ones only refer to, so every pattern runs once
    out = out.withColumns({f"__f{k}": F.regexp_extract_all("__t", F.lit(p), F.lit(0)) for k, (p, _) in enumerate(kinds)})
    none = F.array().cast("array<string>")
    out = out.withColumns({f"__g{k}": F.when(F.size(f"__f{k}") > 0, F.split("__t", p, -1)).otherwise(none) for k, (p, _) in enumerate(kinds)})
    empty = F.array().cast("array<int>")
    out = out.withColumns(
        {f"__o{k}": F.when(F.size(f"__f{k}") > 0, _offsets(F.col(f"__g{k}"), F.col(f"__f{k}"))).otherwise(empty) for k in names}
    )
    out = out.withColumns({f"__s{k}": _spans(F.col(f"__f{k}"), F.col(f"__o{k}"), k, keep) for k, (_, keep) in enumerate(kinds)})
    out = out.withColumn("secrets", F.array_sort(F.concat(*[F.col(f"__s{k}") for k in names])))
    return out.drop("__t", *[f"__{x}{k}" for k in names for x in "fgos"])


def kinds() -> list[str]:
    return [k for k, *_ in BASE] + ["entropy"]


def secrets_digest(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    names = F.array(*[F.lit(k) for k in kinds()])
    text = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["number"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda n: F.size(F.filter("secrets", lambda x: x["number"] == n)).cast("long")
    return spans.select(
        doc_id,
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(text(F.filter("secrets", lambda x: x["number"] < len(BASE))), 256).alias("base_sha256"),
        text(F.col("secrets")).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL of the digest; entropy sums are taken anew for every window here."""
    finds, spans = [], []
    for n, (kind, p, group, least) in enumerate((*BASE, ("entropy", CANDIDATE, 0, 0))):
        q = p.replace("'", "''")
        keep = f"len(regexp_extract(m, '{q}', {group})) >= {least}" if least else "dense(m)"
        finds.append(
            f"SELECT doc_id, {n} AS n, '{kind}' AS kind, regexp_extract_all(t, '{q}') AS f, string_split_regex(t, '{q}') AS g FROM d"
        )
        spans.append((n, keep))
    weights = ", ".join(map(str, _weights(WINDOW)))
    cases = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {most_sum(b, WINDOW)}" for p, b in CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, '{a}')" for a in ALLOW)
    least = " ".join(
        f"WHEN n = {n} THEN len(regexp_extract(m, '{p.replace(chr(39), chr(39) * 2)}', {g})) >= {k}" for n, (_, p, g, k) in enumerate(BASE)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(finds)}),
i AS (SELECT doc_id, n, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM f WHERE len(f) > 0),
s AS (SELECT doc_id, n, kind, f[i] AS m, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS a FROM i),
c AS (SELECT DISTINCT m, CASE {cases} END AS most FROM s WHERE n = {len(BASE)} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allowed})),
w AS (SELECT m, most, unnest(range(1, len(m) - {WINDOW} + 2)) AS p FROM c),
h AS (SELECT m, most, p, string_split(substr(m, p, {WINDOW}), '') AS x FROM w),
u AS (SELECT m, most, p, unnest(x) AS x FROM h),
k AS (SELECT m, most, p, x, count(*) AS c FROM u GROUP BY ALL),
e AS (SELECT m, most, p, sum(([{weights}])[c + 1]) AS total FROM k GROUP BY ALL),
dense AS (SELECT m FROM e GROUP BY m, most HAVING min(total) <= most),
r AS (SELECT doc_id, n, kind, CAST(a AS BIGINT) AS a, CAST(a + len(m) AS BIGINT) AS b FROM s WHERE CASE {least} ELSE m IN (SELECT m FROM dense) END),
o AS (SELECT doc_id, sum((n = 0)::INT) AS n0, sum((n = 1)::INT) AS n1, sum((n = 2)::INT) AS n2,
      string_agg(CASE WHEN n < 3 THEN kind || ':' || a || ':' || b END, ',' ORDER BY a, n) AS base,
      string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
