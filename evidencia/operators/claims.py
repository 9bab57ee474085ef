"""Claims about people against the evidence: binding, validation, known contacts, merging, and what counts as new.

Rows are long: one for each contact of a candidate (candidate, channel, value, source). No step makes pairs that an
equal key hasn't narrowed first, and none gathers a group in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import contains_phrase


def spaced(text: Column) -> Column:
    """Small letters with one space between words, for word-bounded search; signs at a word's edge are spaces too."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def holds_value(channel: Column, value: Column, text: Column) -> Column:
    """Whether a text shows a value: an address as it is, a number by its last nine figures; null texts hold nothing."""
    tail = F.regexp_replace(value, r"\D", "")
    tail = F.substring(tail, F.greatest(F.lit(1), F.length(tail) - 8), F.lit(9))
    number = (tail != "") & F.contains(F.regexp_replace(text, r"\D", ""), tail)
    return F.coalesce(F.when(channel == "email", F.contains(F.lower(text), F.lower(value))).when(channel.isin("phone", "whatsapp"), number).otherwise(F.contains(text, value)), F.lit(False))


def bindings(claims: DataFrame, quotes: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """(claim columns..., bound): whether one quote of a claim's source holds both its name and its value.

    claims: claim_id, source, name, channel, value; quotes and cards: source, text. Cards that hold the name or the
    value veto a claim that no single card holds whole. A claim without source, name or value isn't bound.
    """
    some = claims.where("source is not null and trim(name) <> '' and trim(value) <> ''")

    def met(parts: DataFrame) -> DataFrame:
        both = some.join(parts.select("source", F.col("text").alias("__t")), "source")
        named = contains_phrase(spaced(F.col("__t")), spaced(F.col("name")))
        valued = holds_value(F.col("channel"), F.col("value"), F.col("__t"))
        return both.select("claim_id", named.alias("n"), valued.alias("v")).groupBy("claim_id").agg(F.max(F.col("n") & F.col("v")).alias("whole"), F.max(F.col("n") | F.col("v")).alias("part"))

    out = claims.join(met(quotes).select("claim_id", F.col("whole").alias("__q")), "claim_id", "left")
    bound = F.coalesce("__q", F.lit(False))
    if cards is not None:
        out = out.join(met(cards).select("claim_id", (F.col("part") & ~F.col("whole")).alias("__veto")), "claim_id", "left")
        bound = bound & ~F.coalesce("__veto", F.lit(False))
    return out.select(*claims.columns, bound.alias("bound"))


def sole_owner(bound: DataFrame, contact: list[str], owner: str) -> DataFrame:
    """(contact..., owner): contacts that exactly one owner binds, by the least and the greatest of them."""
    least = bound.groupBy(*contact).agg(F.min(owner).alias(owner), F.max(owner).alias("__hi"))
    return least.where(F.col(owner) == F.col("__hi")).drop("__hi")


def validated(claims: DataFrame, observed: DataFrame, blocked: DataFrame, fetched: DataFrame, quotes: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """(claim columns..., verdict) of each claimed contact against what was fetched; the first that applies.

    'source not fetched', 'no source', 'conflicting' (a blocked channel and value), 'not bound' (no quote of the source
    holds name and value; profiles need none), 'not observed' (no signal of this channel, value and source; guessed
    addresses need none), else 'accepted'. observed: channel, value, source; blocked: channel, value; fetched: source.
    """
    c = bindings(claims, quotes, cards)
    c = c.join(fetched.select("source").distinct().withColumn("__f", F.lit(True)), "source", "left")
    c = c.join(blocked.select("channel", "value").distinct().withColumn("__b", F.lit(True)), ["channel", "value"], "left")
    c = c.join(observed.select("channel", "value", "source").distinct().withColumn("__o", F.lit(True)), ["channel", "value", "source"], "left")
    guessed = (F.col("channel") == "email") & F.coalesce(F.col("status") == "guessed", F.lit(False)) if "status" in claims.columns else F.lit(False)
    verdict = (
        F.when(F.coalesce("source", F.lit("")) == "", "no source")
        .when(F.col("__f").isNull(), "source not fetched")
        .when(F.col("__b"), "conflicting")
        .when(F.col("channel").isin("email", "phone") & ~F.col("bound"), "not bound")
        .when(~guessed & F.col("__o").isNull(), "not observed")
        .otherwise("accepted")
    )
    return c.select(*claims.columns, verdict.alias("verdict"))


def against_known(people: DataFrame, contacts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept people, kept contacts): candidates against contacts that are known already.

    people: id, scope, name key; contacts: id, scope, channel, key, ...; known: scope, channel ('name' among them),
    key. Matched channels are stripped from a candidate; one that matched in any way stays only if a new channel is
    left, and carries matched_by; one that didn't match stays as it is, with an empty matched_by.
    """
    have = known.select("scope", "channel", "key").where("key is not null and key <> ''").distinct().withColumn("__known", F.lit(True))
    tagged = contacts.join(have, ["scope", "channel", "key"], "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    names = people.select("id", "scope", F.lit("name").alias("channel"), F.col("name").alias("key")).join(have, ["scope", "channel", "key"], "left_semi")
    by = tagged.where("__known").select("id", "channel").unionByName(names.select("id", "channel"))
    matched = by.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("matched_by"))
    fresh = tagged.where("not __known").drop("__known")
    left = fresh.select("id").distinct().withColumn("__new", F.lit(True))
    kept = people.join(matched, "id", "left").join(left, "id", "left").where("matched_by is null or __new").drop("__new")
    return kept.withColumn("matched_by", F.coalesce("matched_by", F.lit(""))), fresh


def merged_people(first: DataFrame, extra: DataFrame) -> DataFrame:
    """(scope, key, verified, id, sources): people of two passes by their key; a verified one evicts pending ones.

    Both: scope, key, verified, id. id is that of the first pass where it has the person, else the least of the other.
    """
    all_ = first.withColumn("__pass", F.lit(0)).unionByName(extra.withColumn("__pass", F.lit(1))).where("key is not null and key <> ''")
    best = F.min(F.struct((~F.col("verified")).alias("pending"), "__pass", "id")).alias("b")
    once = all_.groupBy("scope", "key").agg(best, F.countDistinct("__pass").alias("sources"))
    return once.select("scope", "key", (~F.col("b.pending")).alias("verified"), F.col("b.id").alias("id"), "sources")


def contactable(people: DataFrame, contacts: DataFrame, group: str) -> DataFrame:
    """(group, new_people, items): distinct names of verified, unknown people with a channel that isn't guessed; all with any channel.

    people: id, group, name, verified, matched_by; contacts: id, value, status. Blank names and values don't count.
    """
    reach = contacts.where("trim(value) <> ''").groupBy("id").agg(F.max(F.coalesce(F.col("status"), F.lit("")) != "guessed").alias("sure"))
    each = people.join(reach, "id")
    new = F.when(F.col("verified") & (F.col("matched_by") == "") & F.col("sure") & (F.trim("name") != ""), F.lower(F.trim("name")))
    return each.groupBy(group).agg(F.countDistinct(new).alias("new_people"), F.countDistinct("id").alias("items"))


def preferred(hits: DataFrame, group: list[str], good: Column, order: list[str]) -> DataFrame:
    """(group..., good, order...): of each group's rows the first good one, else the first; one minimum."""
    best = F.min(F.struct((~F.coalesce(good, F.lit(False))).alias("__bad"), *order)).alias("b")
    return hits.groupBy(*group).agg(best).select(*group, (~F.col("b.__bad")).alias("good"), *[F.col(f"b.{c}").alias(c) for c in order])


def nearest_place(left: DataFrame, right: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(keys..., value, at, near, distance): for each left value the right value nearest to its place within the radius.

    Both: keys, value, at (a place in characters). Ties go to the earlier place, then the lesser value.
    """
    pairs = left.join(right.select(*keys, F.col("value").alias("near"), F.col("at").alias("__at")), keys).withColumn("distance", F.abs(F.col("at") - F.col("__at"))).where(F.col("distance") <= radius)
    best = F.min(F.struct("distance", "__at", "near")).alias("b")
    return pairs.groupBy(*keys, "value", "at").agg(best).select(*keys, "value", "at", F.col("b.near").alias("near"), F.col("b.distance").alias("distance"))


def waves(df: DataFrame, group: list[str], order: list[str], first: int, more: int) -> DataFrame:
    """Rows with `wave`: the first `first` of each group, then `more` of the rest; all others are left out."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__p", place).where(F.col("__p") <= first + more).withColumn("wave", F.when(F.col("__p") <= first, 1).otherwise(2)).drop("__p")
