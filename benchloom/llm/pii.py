"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Native: regular expressions and higher-order functions over DataFrame columns only. Positions come from splitting a text
at its matches: the lengths of the pieces and of the matches add up to starts. Quantifiers are possessive and starts are
anchored so that Java's engine neither recurses nor rescans long runs; the matches stay those of the plain patterns.

Defined results: a null or empty text has no spans; other columns are kept as they are, repeated rows are treated alike
(every step works on one row); an empty table gives an empty table; working columns are named apart from all input columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import free_prefix

SPAN = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string,score:double,base:boolean>>"
#: Characters on either side in which context words count.
CONTEXT = 48
#: Characters of the blocks from which redacted texts are put together.
REDACT_BLOCK = 4096


@dataclass(frozen=True)
class Kind:
    """``gate``: a cheap test of the text; ``confirm``: of a match (a string column), None: all pass."""

    name: str
    pattern: str
    gate: str
    base: bool
    score: float
    context: str
    boost: float = 0.3
    confirmed: float = 0.0


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, r"(?i)\b(?:e-?mail|contact|write|mailto|correo|courriel|kontakt)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]", True, 0.6, r"(?i)\b(?:ip|addr|address|host|server|login|client)\b"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]", True, 0.5, r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)\b", confirmed=0.3),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", True, 0.6, r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False, 0.3, r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b", confirmed=0.5),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", False, 0.3, r"(?i)\b(?:ssn|social security|tax id|national id)\b", boost=0.5),
    Kind("local_phone", r"(?<![0-9+().-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9-])", "[0-9]", False, 0.3, r"(?i)\b(?:tel|phone|call us|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b\W{0,3}$", boost=0.5),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", "AKIA|gh[pousr]_|xox[abprs]-|eyJ", False, 0.8, r"(?i)\b(?:key|token|secret)\b"),
    Kind("secret", r"(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{20,}+={0,2}", r"(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{20}", False, 0.2, r"(?i)\b(?:token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|passwords?|passwd|pwd|credentials?|bearer|auth)\b", boost=0.4, confirmed=0.2),
)
#: A span needs this score; base kinds are kept whatever their score.
THRESHOLD = 0.75


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """ISO 13616: country and check digits go last, letters become numbers, the remainder is 1."""
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    step = lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


def _confirmed(kind: Kind, m: Column) -> Column:
    """Whether a match passes its kind's checksum or range test."""
    if kind.name == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind.name == "card":
        return F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
    if kind.name == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind.name == "iban":
        return _mod97(m)
    if kind.name == "national_id":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind.name == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("^(.)\\1*$")
    if kind.name == "local_phone":
        return F.length(_digits(m)).between(9, 12)
    return F.lit(True)


def _running(a: Column) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
    return F.aggregate(a, zero, lambda t, x: F.struct((t.s + x).alias("s"), F.concat(t.a, F.array(t.s + x)).alias("a")), lambda t: t.a)


def _blocks(a: Column, size: int = 256) -> Column:
    """Running sums within blocks of ``size``; with _joined they take n·size steps, not n²."""
    return F.when(F.size(a) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / size).cast("int")), lambda b: _running(F.slice(a, b * size + 1, size))))


def _joined(blocks: Column) -> Column:
    ends = _running(F.transform(blocks, lambda x: F.element_at(x, -1)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), ends.alias("e")), lambda z: F.transform(z["x"], lambda v: v + z["e"] - F.element_at(z["x"], -1))))


def _gap(k: Kind, u: str):
    """Characters from the start of one match to the start of the next."""
    return lambda m, i: (F.length(F.get(f"{u}p_{k.name}", i)) + F.when(i > 0, F.length(F.get(f"{u}m_{k.name}", i - 1))).otherwise(0)).cast("bigint")


def _span(k: Kind, order: int, u: str):
    def span(m: Column, i: Column) -> Column:
        before, after = F.get(f"{u}p_{k.name}", i), F.get(f"{u}p_{k.name}", i + 1)
        near = F.right(before, F.lit(CONTEXT)).rlike(k.context) | F.left(after, F.lit(CONTEXT)).rlike(k.context)
        ok = _confirmed(k, m)
        score = F.lit(k.score) + F.when(ok, k.confirmed).otherwise(0.0) + F.when(near, k.boost).otherwise(0.0)
        start = F.get(f"{u}s_{k.name}", i)
        return F.struct(start.alias("start"), F.lit(order).alias("kind_order"), (start + F.length(m)).alias("end"), F.lit(k.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), ok.alias("base"))

    return span


def _kept(k: Kind, threshold: float):
    return lambda s: s["base"] & (F.lit(k.base) | (s["score"] >= threshold))


def _marked(k: Kind):
    return lambda s: s.withField("base", F.lit(k.base))


def _counted(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii_spans", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the column ``out``: the spans of each whole text, by start, then in the order of KINDS.

    Base kinds (email, ip, card, phone): leftmost non-overlapping matches that pass their test; they all stay. Other kinds
    stay at a score of at least ``threshold``: pattern, plus checksum, plus context words. Starts and ends count code points.
    """
    own = [c for c in df.columns if c != out]
    u = free_prefix([*own, out])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    work = df.select(*[F.col(f"`{c}`") for c in own], t.alias(f"{u}t"))
    keep = [F.col(f"`{c}`") for c in own]
    found = []
    for k in KINDS:
        gate = F.contains(f"{u}t", F.lit(k.gate)) if k.gate == "@" else F.col(f"{u}t").rlike(k.gate)
        none = F.array().cast("array<string>")
        found.append(F.when(gate, F.regexp_extract_all(f"{u}t", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"{u}m_{k.name}"))
    work = work.select(*keep, f"{u}t", *found)
    ms = [f"{u}m_{k.name}" for k in KINDS]
    work = work.select(*keep, *ms, *[F.when(F.size(f"{u}m_{k.name}") > 0, F.split(f"{u}t", k.pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"{u}p_{k.name}") for k in KINDS])
    ps = [f"{u}p_{k.name}" for k in KINDS]
    gaps = [F.transform(f"{u}m_{k.name}", _gap(k, u)).alias(f"{u}g_{k.name}") for k in KINDS]
    work = work.select(*keep, *ms, *ps, *gaps)
    work = work.select(*keep, *ms, *ps, *[_blocks(F.col(f"{u}g_{k.name}")).alias(f"{u}b_{k.name}") for k in KINDS])
    work = work.select(*keep, *ms, *ps, *[_joined(F.col(f"{u}b_{k.name}")).alias(f"{u}s_{k.name}") for k in KINDS])
    spans = []
    for order, k in enumerate(KINDS):
        passed = F.filter(F.transform(f"{u}m_{k.name}", _span(k, order, u)), _kept(k, threshold))
        spans.append(F.transform(passed, _marked(k)))
    return work.select(*keep, F.array_sort(F.concat(*spans)).alias(out))


def _merged(spans: Column) -> Column:
    """Runs of overlapping spans as one, with the first one's kind; done runs are put away by 256, so that steps stay short."""
    run = "struct<start:bigint,end:bigint,kind:string>"
    zero = F.struct(F.array().cast(f"array<array<{run}>>").alias("done"), F.array().cast(f"array<{run}>").alias("own"), F.lit(None).cast(run).alias("last"))

    def add(acc: Column, s: Column) -> Column:
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        joins = acc["last"].isNotNull() & (s["start"] < acc["last"]["end"])
        longer = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end"), acc["last"]["kind"].alias("kind"))
        still, full = joins | acc["last"].isNull(), F.size(acc["own"]) >= 256
        done = F.when(still | ~full, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["own"])))
        own = F.when(still, acc["own"]).when(full, F.array(acc["last"])).otherwise(F.concat(acc["own"], F.array(acc["last"])))
        return F.struct(done.alias("done"), own.alias("own"), F.when(joins, longer).otherwise(new).alias("last"))

    return F.aggregate(spans, zero, add, lambda a: F.concat(F.flatten(F.concat(a["done"], F.array(a["own"]))), F.when(a["last"].isNull(), F.array().cast(f"array<{run}>")).otherwise(F.array(a["last"]))))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text cut into blocks."""
    first, last = F.floor(start / REDACT_BLOCK).cast("int"), F.floor(end / REDACT_BLOCK).cast("int")
    at, to = (start % REDACT_BLOCK).cast("int"), (end % REDACT_BLOCK).cast("int")
    own = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    inner = F.concat(F.substring(own(first), at + 1, F.lit(REDACT_BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(own(last), F.lit(1), to))
    return F.when(first == last, F.substring(own(first), at + 1, to - at)).otherwise(inner)


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets; a null stays null.

    A text is cut into blocks once, and what lies between two runs is taken from its blocks: linear in spans and text.
    """
    t = F.col(f"`{text}`")

    def filled(blocks: Column, merged: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(merged, i - 1)["end"]).otherwise(F.lit(0))
            return F.concat(_between(blocks, before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        return F.concat(F.array_join(F.transform(merged, piece), ""), _between(blocks, F.element_at(merged, -1)["end"], F.length(t)))

    new = _with(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{REDACT_BLOCK}}}"), F.lit(0)), lambda blocks: _with(_merged(F.col(f"`{spans}`")), lambda merged: filled(blocks, merged)))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, t).otherwise(new)


def digest(df: DataFrame, spans: str = "pii_spans") -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of base spans, and all spans as text and number."""
    s = F.col(f"`{spans}`")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter(s, _counted(kind))).cast("bigint").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter(s, lambda x: x["base"]), line), ",")
    added = F.size(F.filter(s, lambda x: ~x["base"])).cast("bigint").alias("n_added")
    total = F.size(s).cast("bigint").alias("n_spans")
    return df.select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(s, line), ",").alias("spans"), added, total)
