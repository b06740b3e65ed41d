"""Personal data: regular expressions propose spans, checksum validators confirm them, and words
near a span adjust its score.

Only DataFrame expressions. Offsets are code points, ends exclusive. A null text counts as empty and
has no spans; every row of the input gives one row; equal rows stay equal rows. Patterns are
possessive and anchored at the start of a run, so time is linear in the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

_LOCAL = r"A-Za-z0-9._%+-"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda a, c: F.struct(
            (a["i"] + 1).alias("i"),
            (
                a["s"]
                + F.coalesce(
                    F.when(a["i"] % 2 == 0, c.try_cast("int")).otherwise(
                        F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)
                    ),
                    F.lit(0),
                )
            ).alias("s"),
        ),
        lambda a: a["s"],
    )
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _mod97(match: Column) -> Column:
    """ISO 13616: the first four characters last, letters as 10 to 35, remainder 1 by 97."""
    plain = F.regexp_replace(match, r"\x20", "")
    rest = F.aggregate(
        F.split(F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4)), ""),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).when(F.ascii(c) >= 48, (a * 10 + F.ascii(c) - 48) % 97).otherwise(a),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test without which the pattern can't match.
    needs: str
    confirm: Callable[[Column], Column]
    #: Score of a confirmed span, words that raise it by `near`, and the least score that counts.
    score: float
    context: str
    near: float = 0.3
    least: float = 0.0


BASE: tuple[Kind, ...] = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "mail|contact|kontakt|correo|courriel", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]", _octets, 0.6, "ip|address|host|server|adresse|direcc"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", _luhn, 0.8, "card|visa|master|karte|carte|tarjeta|pay", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), 0.6, "phone|call|tel|mobile|fax"),
)
#: Characters of an IBAN by country (ISO 13616 registry, then countries outside it that use the format).
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ",
    26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HU LB NI PL SV BF BJ CI HN MA ML NE SN TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
EXTRA: tuple[Kind, ...] = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _mod97, 0.9, "iban|bank|account|konto|compte|cuenta", 0.1, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security|tax", 0.4, 0.5),
)
KINDS = (*BASE, *EXTRA)
#: Code points before a span in which context words count, and the most spans that reach into them (no pattern matches less than two).
REACH = 40
_BEFORE = REACH // 2
_CHUNK = 256


def _running(steps: Column) -> Column:
    """Running sums of an array of ints, in two levels so that no long array is appended to."""
    append = lambda values: F.aggregate(
        values,
        F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("o")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["o"], a["s"] + x).alias("o")),
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), lambda c: append(F.slice(steps, c * _CHUNK + 1, _CHUNK)))
    total = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("s"), F.array().cast("array<array<int>>").alias("o")),
        lambda a, c: F.struct((a["s"] + c["s"]).alias("s"), F.array_append(a["o"], F.transform(c["o"], lambda x: x + a["s"])).alias("o")),
        lambda a: F.flatten(a["o"]),
    )
    return F.when(F.size(steps) > 0, total).otherwise(F.array().cast("array<int>"))


def _proposed(kind: Kind, text: Column) -> dict[str, Column]:
    hit = text.contains("@") if kind.needs == "@" else text.rlike(kind.needs)
    return {
        f"_m_{kind.name}": F.when(hit, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))),
        f"_p_{kind.name}": F.when(hit, F.split(text, kind.pattern, -1)),
    }


def _tails(kind: Kind) -> dict[str, Column]:
    """The last code points of each piece with the match after it."""
    found, between = F.col(f"_m_{kind.name}"), F.col(f"_p_{kind.name}")
    return {f"_t_{kind.name}": F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.right(F.concat(F.right(p, F.lit(REACH)), m), F.lit(REACH)))}


def _contexts(kind: Kind) -> dict[str, Column]:
    """The whole text's last code points before each match and before the end."""
    tails, between = F.col(f"_t_{kind.name}"), F.col(f"_p_{kind.name}")
    last = lambda i: F.array_join(F.slice(tails, F.greatest(i - _BEFORE + 1, F.lit(1)), F.least(i, F.lit(_BEFORE))), "")
    # A second mention keeps the optimizer from computing the tails anew for each match.
    return {f"_c_{kind.name}": F.when(F.size(tails) >= 0, F.transform(between, lambda p, i: F.right(F.concat(last(i), F.right(p, F.lit(REACH))), F.lit(REACH))))}


def _spans(kind: Kind) -> Column:
    found, before, ends = F.col(f"_m_{kind.name}"), F.col(f"_c_{kind.name}"), F.col(f"_e_{kind.name}")
    rows = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(before, 1, F.size(found)).alias("c"), ends.alias("e")),
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"),
            (x["e"] - F.length(x["m"])).alias("start"),
            x["e"].alias("end"),
            _raised(kind, x["c"]).alias("score"),
            kind.confirm(x["m"]).alias("ok"),
        ),
    )
    return F.coalesce(F.filter(rows, lambda x: x["ok"] & (x["score"] >= kind.least)), F.array().cast("array<struct<kind:string,start:int,end:int,score:double,ok:boolean>>"))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input's columns and `spans`: kind, start, end, score, by kind as listed, then start."""
    inner = [f"_{x}_{k.name}" for k in kinds for x in "mpetc"]
    keep = [named(c) for c in docs.columns if c not in ("spans", "_t", *inner)]
    plain = docs.select(*keep).withColumn("_t", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01", "\x02"))
    proposed = plain.withColumns({n: c for k in kinds for n, c in _proposed(k, F.col("_t")).items()}).drop("_t")
    steps = lambda k: F.zip_with(F.col(f"_m_{k.name}"), F.slice(f"_p_{k.name}", 1, F.size(f"_m_{k.name}")), lambda m, p: F.length(m) + F.length(p))
    proposed = proposed.withColumns({n: c for k in kinds for n, c in _tails(k).items()}).withColumns({n: c for k in kinds for n, c in _contexts(k).items()})
    summed = proposed.withColumns({f"_e_{k.name}": steps(k) for k in kinds}).withColumns({f"_e_{k.name}": _running(F.col(f"_e_{k.name}")) for k in kinds})
    spans = F.transform(F.concat(*[_spans(k) for k in kinds]), lambda x: F.struct(x["kind"], x["start"], x["end"], x["score"]))
    return summed.withColumn("spans", spans).drop(*inner)


def digest(rows: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, beside the other columns."""
    names = [k.name for k in BASE]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return rows.withColumns(
        {f"n_{n}": count(n) for n in names}
        | {
            "base_sha256": F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(*names))).cast("binary"), 256),
            "spans": shown(F.col("spans")),
        }
    )


def _raised(kind: Kind, before: Column) -> Column:
    """The score of a confirmed span after `before`, its context."""
    near = F.lower(before).rlike(kind.context)
    return F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, F.lit(kind.near)).otherwise(F.lit(0.0)))


def _covered(kind: Kind) -> Callable[[Column], Column]:
    tag = F.lit(f"[{kind.name.upper()}]")
    counts = lambda x: (x["m"] != "") & kind.confirm(x["m"]) & (_raised(kind, x["c"]) >= kind.least)
    return lambda x: F.concat(x["p"], F.when(counts(x), tag).otherwise(x["m"]))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The same rows with each confirmed span of `text` replaced by its kind in brackets; null stays null.

    One kind after another, each in one linear pass over the pieces between its matches.
    """
    out = docs
    for kind in kinds:
        proposed = out.withColumns(_proposed(kind, F.col("text"))).withColumns(_tails(kind)).withColumns(_contexts(kind))
        found, between = F.col(f"_m_{kind.name}"), F.col(f"_p_{kind.name}")
        parts = F.transform(F.arrays_zip(between.alias("p"), F.concat(found, F.array(F.lit(""))).alias("m"), F.col(f"_c_{kind.name}").alias("c")), _covered(kind))
        out = proposed.withColumn("text", F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col("text"))).drop(*[f"_{x}_{kind.name}" for x in "mptc"])
    return out.select(*map(named, docs.columns))
