"""Text functions: letter ids, codes, titles, kinds, names, terms. All are column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spelling of letter ids. Two digits, a hyphen, one of U+2010 to U+2015,
# an underscore or a space, three digits; lists go on over a comma, "and" or "&".
LETTER_ID = r"\d{2}\s*[-‐-―_ ]\s*\d{3}"
LETTER_RUN = rf"(?i)\bAPLs?\s*#?\s*({LETTER_ID}(?:\s*(?:,|and|&)\s*{LETTER_ID})*)"
#: What a cheap scan looks for first; the wide form also passes plurals and other dashes.
PREFILTER = r"(?i)APL\s*#?\s*[0-9]{2}[- ][0-9]{3}"
PREFILTER_WIDE = r"(?i)\bAPLs?"


def letter_ids(text: Column) -> Column:
    """Canonical dd-ddd ids in order, once each; bare ids don't count."""
    runs = F.regexp_extract_all(text, F.lit(LETTER_RUN), F.lit(1))
    ids = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(f"({LETTER_ID})"), F.lit(1))))
    plain = F.transform(ids, lambda i: F.regexp_replace(F.regexp_replace(i, r"\s", ""), r"^(\d{2})[^0-9]?(\d{3})$", "$1-$2"))
    return F.array_distinct(F.coalesce(plain, F.array().cast("array<string>")))


def letter_key(text: Column) -> Column:
    """A bare id as it is, else the first id of the text, else an error."""
    first = F.get(letter_ids(text), 0)
    return F.when(trimmed(text).rlike(r"^\d{2}-\d{3}$"), trimmed(text)).when(first.isNotNull(), first).otherwise(F.raise_error(F.concat(F.lit("no letter id in: "), F.coalesce(text, F.lit("")))))


def authority_key(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9-]", "")


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n"))


def label(number: Column, title: Column) -> Column:
    """Number and title, unless the title begins with the number."""
    n, t = trimmed(F.coalesce(number, F.lit(""))), trimmed(F.coalesce(title, F.lit("")))
    return F.when((n == "") | F.startswith(F.lower(t), F.lower(n)), t).otherwise(trimmed(F.concat(n, F.lit(" "), t)))


def node_id(kind: str | Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, key)


def safe_name(text: Column, most: int = 90, empty: str = "") -> Column:
    """ASCII letters and digits joined by _, at most ``most`` long."""
    out = F.substring(F.regexp_replace(F.regexp_replace(_folded(text), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(out == "", F.lit(empty)).otherwise(out)


def slug_candidates(name: Column, plan_id: Column | None = None, pinned: Column | None = None) -> Column:
    """Host names an organisation may have, in order: its words joined by hyphens, without a leading "the", without each "of", and the plan's id. A pinned one is the only one."""
    base = F.regexp_replace(F.regexp_replace(F.lower(_folded(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.array(base, F.regexp_replace(base, "^the-", ""), F.replace(base, F.lit("-of-"), F.lit("-")), *([] if plan_id is None else [F.lower(plan_id)]))
    out = F.array_distinct(F.filter(out, lambda w: F.coalesce(w, F.lit("")) != ""))
    return out if pinned is None else F.when(F.coalesce(pinned, F.lit("")) != "", F.array(pinned)).otherwise(out)


# Letters that have no decomposition, and what they are written as.
ALONE = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T"}
LONGER = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}


def _plain_letters() -> dict[str, str]:
    """Latin letters and the ASCII letters that they are without their marks."""
    out = dict(ALONE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in LONGER and len(plain) == 1 and plain != c and plain.isascii():
            out[c] = plain
    return out


PLAIN = _plain_letters()


def _folded(text: Column) -> Column:
    """Text in ASCII: letters without their marks, dashes and spaces as plain ones; what has no such form is left out."""
    out = F.translate(text, "".join(PLAIN), "".join(PLAIN.values()))
    for c, plain in LONGER.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\p{Pd}\u2212]", "-"), r"\p{Z}", " "), r"[^\x00-\x7F]", "")


def _first_of(rules: list[tuple[str, Column | str]], other: str, text: Column) -> Column:
    out = F.lit(other)
    for name, rule in reversed(rules):
        out = F.when(text.rlike(rule) if isinstance(rule, str) else rule, F.lit(name)).otherwise(out)
    return out


# Kinds and departments, first match wins.
KINDS = [
    ("formulary", r"formulary|drug list|\bpdl\b"),
    ("member", r"handbook|evidence of coverage|\beoc\b"),
    ("manual", r"manual|ops guide|operations guide|resource guide"),
    ("notice", r"newsletter|bulletin|\bmemos?\b|\balerts?\b|\bnotices?\b"),
    ("form", r"\bforms?\b|application|attestation|checklist|template"),
]
DEPARTMENTS = [
    ("Utilization Management", r"utilization|um-|um_|/um/"),
    ("Pharmacy", r"pharmac|/rx"),
    ("Credentialing", r"credential"),
    ("Quality", r"quality|qm-|qm_"),
    ("Claims", r"claim"),
    ("Clinical", r"clinical|guideline"),
]
GENERIC = ["", "download", "pdf", "here", "view", "click here", "english", "spanish", "link"]


def url_decoded(url: Column) -> Column:
    """Percent escapes decoded; a plus stays, and what can't be decoded is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def doc_kind(url: Column, text: Column) -> Column:
    return _first_of(KINDS, "policy", F.lower(F.concat(text, F.lit(" "), url_decoded(url))))


def listing_kind(title: Column) -> Column:
    """The variant for enumerated listings: manual, form, policy words, else form."""
    t = F.lower(title)
    return F.when(t.contains("manual"), "manual").when(t.rlike("form|request|application"), "form").when(t.rlike(r"policy|procedure|guideline|\bp&p\b"), "policy").otherwise("form")


def department(url: Column, seed: Column) -> Column:
    both = F.lower(F.concat(url, F.lit(" "), seed))
    rest = F.when(F.lower(url).contains("manual"), "Provider Manual").otherwise("Provider Resources")
    out = rest
    for name, rule in reversed(DEPARTMENTS):
        out = F.when(both.rlike(rule), name).otherwise(out)
    return out


def doc_title(text: Column, url: Column) -> Column:
    t = trimmed(F.regexp_replace(text, r"[»›>]+\s*$", ""))
    base = url_decoded(F.regexp_extract(F.regexp_replace(url, r"\?.*$", ""), r"([^/]*)/*$", 1))
    named = F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""), "_|-", " ")
    return F.when(~F.lower(t).isin(GENERIC) & (F.length(t) >= 4), t).otherwise(named)


# Codes in front of titles, of sites and of vendors.
SITE_CODE = r"^([A-Z]{1,6}(?:-[A-Z]{1,4})?-?[0-9]{1,4}[A-Za-z]?)(?:[\s:.,–-]|$)"
VENDOR_CODE = r"^([A-Z]{2,6}[0-9]{1,4}[A-Za-z]?)\b\s*"


def site_code(title: Column) -> Column:
    return F.regexp_extract(title, SITE_CODE, 1)


def vendor_code(name: Column) -> Column:
    return F.regexp_extract(trimmed(name), VENDOR_CODE, 1)


def vendor_title(name: Column) -> Column:
    return F.regexp_replace(trimmed(name), VENDOR_CODE, "")


def letter_year(key: Column) -> Column:
    """19YY from 90 on, else 20YY; null if there are no two digits in front."""
    yy = F.regexp_extract(key, r"^(\d{2})-", 1).try_cast("int")
    return F.when(yy >= 90, 1900 + yy).otherwise(2000 + yy)


def replacement_year(key: Column) -> Column:
    """Always 20YY; later than 2026 is null. Unlike letter_year on purpose: the two rules differ."""
    y = 2000 + F.regexp_extract(key, r"^(\d{2})-", 1).try_cast("int")
    return F.when(y <= 2026, y)


def clock_seconds(clock: Column) -> Column:
    n = F.regexp_extract(clock, r"(\d+)", 1).try_cast("double")
    return n * F.when(F.lower(clock).contains("hour"), 3600.0).otherwise(86400.0)


# Words left out of titles and of questions.
TITLE_STOP = [
    "policy", "policies", "procedure", "procedures", "provider", "providers", "health", "plan", "plans", "medi", "cal",
    "medical", "member", "members", "manual", "and", "for", "the", "of", "to", "in", "a", "services", "service", "care",
    "apl", "program", "management", "review", "requirements", "form",
]
QUESTION_STOP = [
    "what", "when", "does", "must", "have", "with", "that", "this", "from", "into", "many", "much", "should", "would",
    "there", "which", "about", "your", "they", "them", "their",
]
# Retrieval terms of the gates.
GATE_TERMS = {
    "ACK": ["acknowledge", "acknowledgement", "receipt"],
    "RESOLVE_STANDARD": ["thirty", "30 calendar days", "resolution", "resolve"],
    "RESOLVE_EXPEDITED": ["expedited", "72 hours", "seventy-two"],
    "CLASSIFY": ["exempt", "inquiry", "classif"],
}


def terms(text: Column, longer_than: int = 3, stop: list[str] | None = None, stem: int | None = None) -> Column:
    """Distinct lower-case words of letters and digits, by first place."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +")
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))
    if stop:
        words = F.array_except(words, F.array(*map(F.lit, stop)))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, stem))) if stem else words


def gate_terms(gate_id: Column, obligation: Column) -> Column:
    other = F.array_distinct(F.filter(F.split(F.lower(obligation), "[^a-z]+"), lambda w: F.length(w) > 5))
    out = other
    for gate, words in GATE_TERMS.items():
        out = F.when(gate_id == gate, F.array(*map(F.lit, words))).otherwise(out)
    return out


# What asks for a determination.
REFUSED = [
    r"should (i|we|it) (uphold|overturn|deny|approve|grant|reject)",
    r"what (should|would) (i|we) decide",
    r"(is|are) (this|the) (case|grievance|appeal).{0,30}(expedited|urgent)",
    r"(do|does) (this|it) meet .{0,20}expedited",
    r"what('s| is) the (right |correct )?disposition",
    r"(uphold|overturn) (this|it)\b",
    r"decide (this|it) for me",
    r"tell me (what|how) to (decide|rule)",
]


def asks_determination(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike("(?i)(" + "|".join(REFUSED) + ")")


def snippet(text: Column, words: list[str], width: int = 320, back: int = 90) -> Column:
    """Flattened text from ``back`` before the first word found (words in the order asked), escaped, words marked."""
    flat = trimmed(F.regexp_replace(text, r"\s+", " "))
    found = reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.instr(F.lower(flat), w.lower()), F.lit(0)) for w in words], F.lit(None).cast("int"))
    start = F.greatest(F.lit(1), F.coalesce(found, F.lit(1)) - back)
    cut = flat.substr(start, F.lit(width + 1))
    out = F.replace(F.replace(F.replace(cut, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for w in words:
        out = F.regexp_replace(out, "(?i)(" + "".join("\\" + c if not c.isalnum() else c for c in w) + ")", "<mark>$1</mark>")
    return F.concat(F.when(start > 1, F.lit("… ")).otherwise(F.lit("")), out, F.lit(" …"))


def page_url(base: Column, plan: Column, filename: Column, page: Column) -> Column:
    """Document address with the page in query and fragment; spaces as %20; null if a part is missing."""
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    n = page.cast("string")
    return F.concat(base, F.lit("/"), part(plan), F.lit("/"), part(filename), F.lit("?page="), n, F.lit("#page="), n)


def display_id(control: Column) -> Column:
    """ac-2.1 as AC-2(1)."""
    return F.regexp_replace(F.upper(control), r"^([A-Z]+-\d+)\.(\d+)$", "$1($2)")


def subject(title: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(title, r"^APL \d\d-\d\d\d:\s*", ""), r"(?i)\s*\(?Supersed[^)]*\)?.*$", ""))


def age_on(birth: Column, on: Column) -> Column:
    """Whole years: one less while the birthday (month, day) is still to come in the year."""
    ahead = (F.month(on) * 100 + F.day(on)) < (F.month(birth) * 100 + F.day(birth))
    return (F.year(on) - F.year(birth) - ahead.cast("int")).cast("int")


def tolerant_number(payload: Column, path: str) -> Column:
    """A number in JSON text; missing, empty or NA is null."""
    return F.nullif(F.nullif(F.get_json_object(payload, path), F.lit("")), F.lit("NA")).try_cast("double")


def remaining_text(hours: Column, met: Column) -> Column:
    h = F.abs(hours)
    span = F.when(h >= 48, F.concat(F.format_number(h / 24, 0), F.lit(" days"))).otherwise(F.concat(F.format_number(h, 0), F.lit(" h")))
    return F.when(met, "answered").when(hours.isNull(), "no clock").when(hours < 0, F.concat(span, F.lit(" overdue"))).otherwise(F.concat(span, F.lit(" left")))


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def robots_pattern(rule: Column) -> Column:
    """A robots rule as a regular expression: * is a wildcard, a last $ an anchor, all else literal."""
    anchored = F.endswith(rule, F.lit("$"))
    body = F.when(anchored, F.regexp_replace(rule, r"\$$", "")).otherwise(rule)
    escaped = F.regexp_replace(F.regexp_replace(body, r"([\]\[{}().^$+?|\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), escaped, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def robots_rules(text: Column) -> Column:
    """Non-empty Disallow rules of the groups for *; consecutive agent lines are one group, any rule ends it."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: trimmed(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    zero = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("was"), F.array().cast("array<string>").alias("rules"))

    def step(s: Column, line: Column) -> Column:
        agent = line.rlike(r"(?i)^user-agent\s*:")
        name = trimmed(F.regexp_replace(line, r"(?i)^user-agent\s*:", ""))
        rule = trimmed(F.regexp_replace(line, r"(?i)^disallow\s*:", ""))
        counts = line.rlike(r"(?i)^disallow\s*:") & F.array_contains(s["agents"], "*") & (rule != "")
        agents = F.when(agent, F.concat(F.when(s["was"], s["agents"]).otherwise(F.array().cast("array<string>")), F.array(name))).otherwise(s["agents"])
        return F.struct(agents.alias("agents"), agent.alias("was"), F.when(counts, F.concat(s["rules"], F.array(rule))).otherwise(s["rules"]).alias("rules"))

    return F.aggregate(lines, zero, step, lambda s: s["rules"])


def robots_allowed(url: Column, rules: Column) -> Column:
    path = F.regexp_replace(url, "^https?://[^/]+", "")
    path = F.when(path == "", "/").otherwise(path)
    return ~F.exists(rules, lambda r: F.regexp_like(path, robots_pattern(r)))
