"""URL perturbations used to test how robust a detector is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlgauge.functions.url import with_split_url

ATTACKS = ("subdomain", "tracking", "encode", "homoglyph")


@dataclass(frozen=True)
class AttackText:
    """The texts an attack inserts."""

    subdomain: str
    tracking: str


# The two published parameter sets.
TEXT_MODEL_ATTACK = AttackText("secure-check", "utm_source=email&utm_campaign=security_update")
HYBRID_MODEL_ATTACK = AttackText("sec-check", "utm_source=mail&utm_campaign=security")

# Look-alike spellings (capital I for a lower-case l).
HOMOGLYPHS = (("login", "Iogin"), ("paypal", "paypaI"))


def percent_encode_path(path: Column) -> Column:
    """Percent-encode UTF-8 bytes, leaving ``/`` and unreserved characters.

    Form encoding differs from path encoding in four characters, put right here.
    """
    encoded = F.url_encode(path)
    for form, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(wanted))
    return encoded


def join_url(parts: Column, **changed: Column) -> Column:
    """Put a split URL together again; an empty query or fragment leaves no mark."""
    part = {name: changed.get(name, parts[name]) for name in ("scheme", "netloc", "path", "query", "fragment")}
    return F.concat(
        part["scheme"],
        F.lit("://"),
        part["netloc"],
        part["path"],
        F.when(part["query"] == "", "").otherwise(F.concat(F.lit("?"), part["query"])),
        F.when(part["fragment"] == "", "").otherwise(F.concat(F.lit("#"), part["fragment"])),
    )


def attack_expression(attack: str, url: Column, parts: Column, text: AttackText) -> Column:
    """One attack by name; an unknown name leaves the URL alone.

    Attacks that need a split URL give NULL for a malformed one.
    """
    if attack == "subdomain":
        return join_url(parts, netloc=F.concat(F.lit(text.subdomain + "."), parts["netloc"]))
    if attack == "tracking":
        query = F.when(parts["query"] == "", text.tracking).otherwise(
            F.concat(parts["query"], F.lit("&" + text.tracking))
        )
        return join_url(parts, query=query)
    if attack == "encode":
        return join_url(parts, path=percent_encode_path(parts["path"]))
    if attack == "homoglyph":
        changed = url
        for plain, lookalike in HOMOGLYPHS:
            changed = F.replace(changed, F.lit(plain), F.lit(lookalike))
        return changed
    return url


def apply_attack(
    df: DataFrame, attack: str, url: str = "url", into: str = "url_adv", text: AttackText = TEXT_MODEL_ATTACK
) -> DataFrame:
    """Add ``into``: each row's URL after the attack that its ``attack`` column names."""
    split = with_split_url(df, url, "_parts")
    changed = F.col(url)
    for name in ATTACKS:
        variant = attack_expression(name, F.col(url), F.col("_parts"), text)
        changed = F.when(F.col(attack) == name, variant).otherwise(changed)
    return split.withColumn(into, changed).drop("_parts")


def explode_attacks(
    df: DataFrame,
    url: str = "url",
    text: AttackText = TEXT_MODEL_ATTACK,
    attacks: Sequence[str] = ATTACKS,
) -> DataFrame:
    """One row per input row and attack: ``url_orig, url_adv, attack`` + other columns.

    A map-side explode, so the rows x attacks product needs no join or shuffle.
    """
    others = [name for name in df.columns if name != url]
    split = with_split_url(df, url, "_parts")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("attack"),
                attack_expression(name, F.col(url), F.col("_parts"), text).alias("url_adv"),
            )
            for name in attacks
        ]
    )
    return split.select(
        F.col(url).alias("url_orig"), *others, F.explode(rows).alias("_row")
    ).select("url_orig", "_row.url_adv", "_row.attack", *others)
