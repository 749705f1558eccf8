"""Structured chunks against a plain walk over every character."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.sources import chunks
from plumbline.sources.documents import METADATA


def rank_of(text, p):
    """Of the border at p, or None where there is none."""
    if p == 0 or not text[p - 1].isspace() or p >= len(text) or text[p].isspace():
        return None
    gap = text[len(text[:p].rstrip()) : p]
    if "\n" in gap:
        return 3 if re.match(r"#{1,6}[ \t]+\S", text[p:]) and text[p - 1] == "\n" else 2 if gap.count("\n") > 1 else 1
    return 1 if re.search(r"[.!?][\"')\]]*$", text[: p - len(gap)]) else 0


def naive(text, size, overlap):
    n = len(text.rstrip())
    ranks = {p: r for p in range(len(text)) if (r := rank_of(text, p)) is not None}
    start, end, out = len(text) - len(text.lstrip()), 0, []
    while end < n:
        if start + size >= n:
            return [*out, (start, n)]
        fit = {p: r for p, r in ranks.items() if max(end, start) < p <= start + size}
        late = {p: r for p, r in fit.items() if r and p > start + size // 2}
        early = [p for p, r in fit.items() if r]
        if late:
            stop = max(late, key=lambda p: (late[p], p))
        elif early:
            stop = max(early)
        elif fit:
            stop = max(fit)
        else:
            stop = min((p for p in ranks if p > start + size), default=n)
        out.append((start, len(text[:stop].rstrip())))
        end = stop
        start = min((p for p, r in ranks.items() if r and p > start and stop - int(size * overlap) <= p < stop), default=stop)
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 3, 5, 9, 9, 40 if rng.random() < 0.1 else 4])))
    out = []
    for _ in range(rng.randrange(1, 60)):
        out.append(rng.choice([word() + " ", word() + " ", word() + " ", word() + ". ", word() + '?" ', "\n", "\n\n", "\n## " + word() + " " + word() + "\n", "\n# " + word() + "\n", "  ", word() + "\t"]))
    return "".join(out)


@pytest.mark.parametrize("size,overlap", [(30, 0.5), (60, 0.25), (20, 0.0), (25, 0.9)])
def test_equals_a_plain_walk(size, overlap):
    for seed in range(150):
        text = made(seed)
        got = chunks.cut(text, size, overlap)
        assert got == naive(text, size, overlap), text
        body = set(range(len(text))) - {k for k, c in enumerate(text) if c.isspace()}
        assert body == {k for a, z in got for k in range(a, z)} & body  # nothing is lost
        for a, z in got:  # no word is cut
            assert (a == 0 or text[a - 1].isspace()) and (z == len(text) or text[z].isspace() or z == len(text.rstrip()))
        assert [a for a, _ in got] == sorted({a for a, _ in got})


def test_headings():
    text = "intro\n# One\ntext\n## Sub ##\nmore\n### Deep\nx\n## Next\ny\n# Two\nz #no heading"
    at = [text.index(w) for w in ("intro", "text", "more", "x\n", "y\n", "z ")]
    assert chunks.contexts(text, at) == ["", "One", "One\nSub", "One\nSub\nDeep", "One\nNext", "Two"]
    assert chunks.cut("", 10, 0.5) == [] == chunks.cut(" \n ", 10, 0.5)


def test_documents(spark):
    cat = spark.createDataFrame([("p", "a.pdf", "N1", "Title")], "plan_id string, filename string, policy_number string, title string")
    for c in METADATA:
        cat = cat if c in cat.columns else cat.withColumn(c, F.lit("x"))
    pages = spark.createDataFrame([("p/a.pdf", 1, "# Head\nOne two three."), ("p/a.pdf", 2, "Four five six."), ("q/b.pdf", 1, "## Alone\nword"), ("q/none.pdf", 1, None)], "origin string, page int, text string")
    names = spark.createDataFrame([("p", "Plan")], "plan_id string, name string")
    got = {(r.origin, r.start): (r.context, r.text, r.page, r.page_count, r.title) for r in chunks.structured(cat, pages, METADATA, names, 24, 0.5).collect()}
    assert got == {
        ("p/a.pdf", 1): ("Plan · N1 Title", "# Head\nOne two three.", 1, 2, "Title"),
        ("p/a.pdf", 24): ("Plan · N1 Title\nHead", "Four five six.", 2, 2, "Title"),
        ("q/b.pdf", 1): ("", "## Alone\nword", 1, 1, None),
    }
