"""Prompt classification: ordered keyword groups over lower-cased text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
KEYWORDS = {
    "bugfix": ("fix", "bug", "broken", "error", "crash", "issue", "debug", "failing", "fails", "wrong", "regression", "workaround", "patch", "hotfix",
               "not working", "doesn't work", "does not work", "isn't working", "stopped working"),
    "refactor": ("refactor", "rename", "clean up", "extract", "reorganize", "simplify", "restructure", "move", "split", "consolidate", "deduplicate", "dedup",
                 "inline", "remove", "delete", "deprecate", "replace", "convert", "rewrite", "tidy"),
    "testing": ("test", "tests", "testing", "spec", "specs", "unit test", "integration test", "e2e", "coverage", "assert", "mock", "fixture", "snapshot"),
    "plan": ("plan", "the plan", "implement the plan", "read and implement"),
    "review": ("review", "audit", "validate", "verify", "inspect", "look at", "take a look", "examine", "analyze", "analyse", "assess", "evaluate", "feedback", "critique"),
    "ops": ("deploy", "release", "migrate", "upgrade", "bump", "publish", "install", "commit", "push", "merge", "rebase", "cherry-pick", "rollback", "revert",
            "configure", "provision", "ci", "cd", "docker", "k8s", "kubernetes", "terraform", "ansible"),
    "question": ("why", "how does", "how do", "how can", "how to", "how much", "how often", "how many", "what is", "what does", "what are", "where is", "where does",
                 "where are", "when does", "when is", "which", "can you tell", "can you explain", "explain", "understand", "show me", "discover", "research",
                 "what happens", "is there", "are there", "do we", "does this", "could you", "tell me"),
    "docs": ("readme", "changelog", "documentation", "docstring", "comment", "comments", "docs", "doc", "runbook", "adr"),
    "writing": ("write", "draft", "article", "post", "blog"),
    "feature": ("add", "implement", "create", "build", "new feature", "integrate", "introduce", "design", "make", "change", "modify", "adjust", "tweak", "set up",
                "setup", "enable", "support", "extend", "enhance", "improve", "optimize", "update"),
}
BUGFIX_STARTS = ("fix ", "debug ", "patch ", "hotfix ", "resolve ", "repair ", "workaround ")
QUESTION_STARTS = (
    "explain", "what is", "what are", "what does", "what happens", "why does", "why is", "why do", "why are", "how does", "how do", "how can", "how to", "show me",
    "tell me", "describe", "summarize", "summarise", "walk me through", "walk through", "can you explain", "can you tell", "is there", "are there",
)


def word_pattern(word: str) -> str:
    """The word with no ASCII letter or digit beside it, without lookaround."""
    return f"(^|[^a-z0-9]){re.escape(word).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-')}($|[^a-z0-9])"


def classify(text: Column) -> Column:
    """struct(category, source, confidence) of a prompt, or null for short, structural or unclear ones."""

    def hits(low: Column) -> Column:
        starts = lambda phrases: low.rlike("^(" + "|".join(re.escape(p).replace("\\ ", " ") for p in phrases) + ")")
        counts = [sum((low.rlike(word_pattern(w)).cast("int") for w in words), F.lit(0)).alias(k) for k, words in KEYWORDS.items()]
        return F.struct(low.alias("low"), *counts, starts(QUESTION_STARTS).alias("asks"), starts(BUGFIX_STARTS).alias("acts"), low.endswith("?").alias("asked"))

    def category(h: Column) -> Column:
        order = [
            ("bugfix", h["bugfix"], (h["bugfix"] > 0) & (h["acts"] | ~h["asks"])),
            *[(c, h[k], h[k] > 0) for c, k in (("refactor", "refactor"), ("testing", "testing"), ("feature", "plan"), ("review", "review"), ("ops", "ops"))],
            ("question", F.greatest(h["question"], h["asked"].cast("int")), (h["question"] > 0) | h["asked"]),
            *[(k, h[k], h[k] > 0) for k in ("docs", "writing", "feature")],
        ]
        chosen = F.lit(None).cast("struct<category:string,hits:int>")
        for name, n, when in reversed(order):
            chosen = F.when(when, F.struct(F.lit(name).alias("category"), n.alias("hits"))).otherwise(chosen)
        return F.struct(h.alias("h"), chosen.alias("c"))

    def result(x: Column) -> Column:
        h, c = x["h"], x["c"]
        plain = ~h["low"].startswith("/") & (F.octet_length(h["low"]) >= 5) & ~(h["low"].startswith("<") & ~h["low"].contains(" "))
        context = (F.octet_length(h["low"]) >= 40) | h["asks"] | h["acts"]
        confidence = F.when(c["hits"] >= 2, "high").when((c["hits"] == 1) & context, "medium").otherwise("low")
        return F.when(plain & c.isNotNull(), F.struct(c["category"].alias("category"), F.lit("rule").alias("source"), confidence.alias("confidence")))

    return let(F.lower(text), lambda low: let(hits(low), lambda h: let(category(h), result)))
