"""Versions, advisories' scores and severities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("Info", "Low", "Medium", "High", "Critical")


def severity_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), code.cast("int") + 1)


def severity_code(name: Column) -> Column:
    """The ordinal of a severity's name (MODERATE is Medium), null for others."""
    low = F.lower(F.trim(name))
    out = F.when(low == "moderate", F.lit(2))
    for i, s in enumerate(SEVERITIES):
        out = out.when(low == s.lower(), F.lit(i))
    return out


def normalise_version(version: Column) -> Column:
    """Without quotes and blanks, and without a v before a digit."""
    return F.regexp_replace(F.regexp_replace(version, r"""\A[\s"']+|[\s"']+\z""", ""), r"\A[vV](?=[0-9])", "")


def is_exact_version(version: Column) -> Column:
    return version.rlike(r"\A[0-9][0-9A-Za-z.+_-]*\z")


def npm_name(spec: Column) -> Column:
    """name of name@range; a scope's at sign stays."""
    return F.regexp_extract(spec, r"\A(.+?)@[^@]*\z", 1)


def is_commit_hash(text: Column) -> Column:
    return text.rlike(r"\A[0-9A-Fa-f]{7,}\z")


_SEMVER = r"\A[vV]?([0-9]{1,9})\.([0-9]{1,9})\.([0-9]{1,9})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"


def semver_key(tag: Column) -> Column:
    """A struct that sorts as semantic versions do; null for other texts.

    A release sorts above its pre-releases; identifiers compare one by one, numbers below words, shorter lists first.
    """
    part = lambda i: F.regexp_extract(tag, _SEMVER, i)
    pre = F.filter(F.split(part(4), r"\."), lambda x: x != "")
    padded = F.transform(pre, lambda x: F.when(x.rlike(r"\A[0-9]+\z"), F.concat(F.lit("0"), F.lpad(x, 18, "0"))).otherwise(F.concat(F.lit("1"), x)))
    key = F.struct(
        part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), part(3).try_cast("int").alias("patch"),
        (part(4) == "").alias("is_release"), padded.alias("pre"),
    )
    return F.when(tag.rlike(_SEMVER), key)


# CVSS 3.x weights of the base metrics.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def _weights(table: dict[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), key)


def cvss_base(vector: Column) -> Column:
    """The CVSS 3.x base score of a vector; null without all its metrics."""
    metric = lambda name: F.regexp_extract(vector, rf"(?:\A|/){name}:([A-Z])(?:/|\z)", 1)
    w = {name: _weights(table, metric(name)) for name, table in CVSS.items()}
    scope = metric("S")
    changed = scope == "C"
    pr = F.when(changed, _weights(CVSS_PRIVILEGES["C"], metric("PR"))).when(scope == "U", _weights(CVSS_PRIVILEGES["U"], metric("PR")))
    iss = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, 15)).otherwise(6.42 * iss)
    ease = 8.22 * w["AV"] * w["AC"] * pr * w["UI"]
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease))
    # Up to one decimal, in whole hundred-thousandths so that 4.02 stays above 4.0 and 4.0 stays 4.0.
    scaled = F.round(raw * 100_000).cast("long")
    up = F.when(F.pmod(scaled, F.lit(10_000)) == 0, scaled / 100_000).otherwise((F.floor(scaled / 10_000) + 1) / 10)
    known = vector.rlike(r"\ACVSS:3\.[01]/") & (impact + ease).isNotNull()
    return F.when(known, F.when(impact <= 0, F.lit(0.0)).otherwise(up))


def advisory_severity(score: Column, database: Column) -> Column:
    """The severity code: by score if above 0, else the database's word, else Medium."""
    return F.when(score >= 9, F.lit(4)).when(score >= 7, F.lit(3)).when(score >= 4, F.lit(2)).when(score > 0, F.lit(1)).otherwise(F.coalesce(severity_code(database), F.lit(2)))
