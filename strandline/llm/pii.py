"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

All of it is Spark SQL functions. Spark has no function for the places of matches, so
``split`` gives the texts between them, and running lengths give the places. Running sums
go by blocks and parts of a text are cut from chunks, so that the work stays about
linear in a text of any length with any number of spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import free_prefix, table


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid_ip(match: Column) -> Column:
    return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def _valid_card(match: Column) -> Column:
    number = _digits(match)
    return F.length(number).between(16, 19) & F.call_function("luhn_check", number)


def _valid_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def _valid_iban(match: Column) -> Column:
    """Country and check digits behind the rest, letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    left = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
    return F.length(plain).between(15, 34) & (left == 1)


def _valid_ssn(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


def _trimmed_iban(match: Column) -> Column:
    """The match without as many groups at its end as leave a valid number, the longest first; the whole match where none does."""
    groups = F.split(match, " ")
    shorter = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.coalesce(F.get(F.filter(shorter, lambda c: F.coalesce(_valid_iban(c), F.lit(False))), F.lit(0)), match)


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``trim`` shortens, ``valid`` confirms; ``score`` is raised by a context word, which no letter touches, within the characters before or after the span."""

    name: str
    pattern: str
    valid: object
    score: float
    context: str
    base: bool
    trim: object = None


#: Characters of an IBAN by country (a fixed register).
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A number of the country's length, whatever follows it.
_FIXED = "(?:" + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN.items()) + ")(?![A-Za-z0-9])"
#: Others may end in groups that are not theirs, but never run into the next number.
_OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_FIXED})\x20?[A-Z0-9]{{4}}){{2,7}}+(?:(?!\x20{_FIXED})\x20?[A-Z0-9]{{1,3}})?+(?![A-Za-z0-9])"

#: Possessive repeats and the look behind keep the leftmost match and make each search linear: a run of
#: characters that may start a match is tried once, or again right where the match before ended (\G).
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "e-?mails?|contact|write to|correo|courriel", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _valid_ip, 0.6, "addresses|address|adresse|host|server|login|ips?", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _valid_card, 0.8, "cards?|visa|mastercard|credit|payment|kreditkarte|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _valid_phone, 0.6, "phones?|telephone|telefon|téléphone|teléfono|call|tel|mobile|cell|fax", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_FIXED}|{_OTHER})", _valid_iban, 0.8, "iban|accounts?|konto|compte|cuenta", False, _trimmed_iban),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _valid_ssn, 0.3, "ssn|social security", False),
    Kind("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda m: F.lit(True), 0.3, "phones?|telephone|telefon|téléphone|teléfono|call|tel|mobile|cell|fax", False),
)
#: What a context word adds, how far before and after the span it is looked for, and the least score of a span. Base spans reach it alone.
GAIN, REACH, LEAST = 0.3, 40, 0.5
SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Characters of a chunk of text, and values of a block of a running sum.
CHUNK, BLOCK = 4096, 64


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), 0)


def _cut(chunks: Column, at: Column, length: Column) -> Column:
    """``length`` characters from ``at`` on, of which only the chunks that hold them are read."""
    first, last = F.floor(at / CHUNK).cast("int"), F.floor((at + length - 1) / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(held, F.pmod(at, F.lit(CHUNK)) + 1, length)


def _blocks(values: Column, merge) -> Column:
    """The values of each block merged."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int"))
    return F.transform(starts, lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), F.lit(0), merge))


def _before(values: Column, blocks: Column, merge) -> Column:
    """For each place the values before it merged, from its block and the blocks before that."""
    heads = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), merge))
    inner = lambda i: F.aggregate(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, F.pmod(i, F.lit(BLOCK))), F.lit(0), merge)
    # an array of pairs first: the heads are worked out once, not for each place
    parts = F.transform(heads, lambda head, b: F.transform(F.slice(values, b * BLOCK + 1, BLOCK), lambda _, i: merge(head, inner(b * BLOCK + i))))
    return F.flatten(parts)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(kind: Kind, mark: str) -> Column:
    """The spans of one kind that are confirmed and score enough, as an array of SPAN."""
    matches, chunks = F.col(f"{mark}m_{kind.name}"), F.col(f"{mark}chunks")
    # one array, so that the running sums are worked out once a row
    together = F.arrays_zip(matches, F.col(f"{mark}g_{kind.name}"), F.col(f"{mark}e_{kind.name}"))
    match, gap, before = (lambda x, c=c: x[f"{mark}{c}_{kind.name}"] for c in "mge")
    proposed = F.transform(F.filter(together, lambda x: match(x).isNotNull()), lambda x: F.struct((before(x) + F.char_length(gap(x))).alias("start"), (kind.trim(match(x)) if kind.trim else match(x)).alias("match")))

    def scored(p: Column) -> Column:
        start, end = p["start"], p["start"] + F.char_length(p["match"])
        reach = F.least(start, F.lit(REACH))
        words = rf"(?<!\p{{L}})(?:{kind.context})(?!\p{{L}})"
        near = F.lower(_cut(chunks, start - reach, reach)).rlike(words) | F.lower(_cut(chunks, end, F.lit(REACH))).rlike(words)
        score = F.lit(kind.score) + F.when(near, GAIN).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.transform(F.filter(proposed, lambda p: kind.valid(p["match"])), scored)
    return F.when(F.size(matches) > 0, F.filter(found, lambda s: s["score"] >= LEAST)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _found(docs: DataFrame, text_column: str, to: str, mark: str) -> DataFrame:
    """The documents with the spans of each kind in ``{to}_{kind}`` and the text's chunks, where it has a match, in ``{mark}chunks``."""
    names, text = docs.columns, F.coalesce(F.col(text_column), F.lit(""))
    of = lambda c: [F.col(f"{mark}{c}_{k.name}") for k in KINDS]
    step = docs.select(*names, *[F.regexp_extract_all(text, F.lit(k.pattern), 0).alias(f"{mark}m_{k.name}") for k in KINDS])
    some = F.greatest(*[F.size(m) for m in of("m")]) > 0
    gaps = [F.when(F.size(m) > 0, F.split(text, k.pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"{mark}g_{k.name}") for k, m in zip(KINDS, of("m"))]
    step = step.select("*", F.when(some, _chunks(text)).otherwise(F.array().cast("array<string>")).alias(f"{mark}chunks"), *gaps)
    length = lambda m, g: F.transform(m, lambda x, i: F.char_length(F.get(g, i)) + F.char_length(x))
    step = step.select("*", *[length(m, g).alias(f"{mark}l_{k.name}") for k, m, g in zip(KINDS, of("m"), of("g"))])
    step = step.select("*", *[_blocks(x, _add).alias(f"{mark}b_{k.name}") for k, x in zip(KINDS, of("l"))])
    step = step.select("*", *[_before(x, b, _add).alias(f"{mark}e_{k.name}") for k, x, b in zip(KINDS, of("l"), of("b"))])
    return step.select(*names, f"{mark}chunks", *[_spans(k, mark).alias(f"{to}_{k.name}") for k in KINDS])


def find(docs: DataFrame, text_column: str = "text", to: str = "pii") -> DataFrame:
    """The documents with an array of spans for each kind in ``{to}_{kind}``, in text order.

    Places are code points, the end exclusive; a span's score is what its kind gives and
    context adds. A null or empty text has no spans; rows, repeated or not, keep their
    other columns, whatever their names, but for those named ``{to}_*``, which must not
    be there; an empty table gives no rows.
    """
    return _found(docs, text_column, to, free_prefix([*docs.columns, to])).select(*docs.columns, *[f"{to}_{k.name}" for k in KINDS])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, the list of all spans and their scores, of every document."""
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    found = find(named)
    base = [F.col(f"pii_{k.name}") for k in KINDS if k.base]
    every = F.concat(*[F.col(f"pii_{k.name}") for k in KINDS])
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS]
    scores = F.array_join(F.transform(every, lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_listed(F.concat(*base)).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, of the kind that starts first.

    A null text stays null; repeated rows and other columns stay, whatever their names;
    an empty table gives no rows.
    """
    names, mark = docs.columns, free_prefix(docs.columns)
    col = lambda c: F.col(mark + c)
    found = _found(docs, text_column, f"{mark}pii", mark)
    every = F.array_sort(F.transform(F.concat(*[col(f"pii_{k.name}") for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = found.select(*names, col("chunks"), every.alias(f"{mark}spans"))
    step = step.select("*", F.transform(col("spans"), lambda s: s["end"]).alias(f"{mark}ends"))
    step = step.select("*", _blocks(col("ends"), _most).alias(f"{mark}blocks"))
    # where the text before a span begins: the largest end so far
    step = step.select("*", _before(col("ends"), col("blocks"), _most).alias(f"{mark}from"))
    apart = F.filter(F.arrays_zip(col("spans"), col("from")), lambda x: x[f"{mark}spans"]["start"] >= x[f"{mark}from"])
    parts = F.transform(apart, lambda x: F.concat(_cut(col("chunks"), x[f"{mark}from"], x[f"{mark}spans"]["start"] - x[f"{mark}from"]), F.lit("["), F.upper(x[f"{mark}spans"]["kind"]), F.lit("]")))
    last = F.array_max(col("ends"))
    clean = F.concat(F.array_join(parts, ""), _cut(col("chunks"), last, F.char_length(text_column) - last))
    return step.select(*[F.when(F.size(col("spans")) > 0, clean).otherwise(F.col(c)).alias(c) if c == text_column else F.col(c) for c in names])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
