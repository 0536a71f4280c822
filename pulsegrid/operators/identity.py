"""Identities of people: platform accounts and commit addresses resolved to contributors, in sets.

Tables. contributors: cntrb_id, login, email, full_name, canonical. identities: platform_id, user_id, cntrb_id, login, name, email.
aliases: alias_email, cntrb_id, canonical_email. unresolved: email. Empty texts count as missing.

An account belongs to the contributor that its identity names, else to the one that has its first login, else to a new
one. Accounts that are new together and share a first login become one contributor; the account seen first (by seq, then
number) gives its id, which is a function of platform and number, so that two runs over the same rows agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .merge import insert_absent, upsert


class People(NamedTuple):
    accounts: DataFrame
    contributors: DataFrame
    identities: DataFrame


def _text(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _newest(c: str) -> Column:
    """The newest value that is not missing."""
    return F.max_by(_text(c), F.when(_text(c).isNotNull(), F.struct("seq", c))).alias(c)


def login_ids(contributors: DataFrame) -> DataFrame:
    """login, cntrb_id: the least id where several contributors have a login."""
    return contributors.filter(_text("login").isNotNull()).groupBy("login").agg(F.min("cntrb_id").alias("cntrb_id"))


def resolve_accounts(sightings: DataFrame, contributors: DataFrame, identities: DataFrame) -> People:
    """sightings: seq, platform_id, user_id, login, name, email. Accounts without a number are left to their addresses.

    accounts: platform_id, user_id, cntrb_id, how (identity, login, new). A contributor found by login takes a newer address
    and name; one found by identity stays as it is, as does the identity.
    """
    first_login = F.min_by(_text("login"), F.when(_text("login").isNotNull(), F.struct("seq", "login"))).alias("first_login")
    seen = sightings.filter("platform_id is not null and user_id > 0").groupBy("platform_id", "user_id").agg(F.min("seq").alias("seen"), first_login, _newest("login"), _newest("name"), _newest("email"))
    held = identities.select("platform_id", "user_id", F.col("cntrb_id").alias("held"))
    named = login_ids(contributors).select(F.col("login").alias("first_login"), F.col("cntrb_id").alias("named"))
    rows = seen.join(held, ["platform_id", "user_id"], "left").join(named, "first_login", "left")
    own = S.person_uuid(F.col("platform_id"), F.col("user_id"))
    fresh = rows.filter("held is null and named is null")
    # The login's first account stands for all; one aggregation, so a login that many accounts share is no hot group.
    made = fresh.filter("first_login is not null").groupBy("first_login").agg(F.min_by(own, F.struct("seen", "platform_id", "user_id")).alias("made"))
    rows = rows.join(made, "first_login", "left")
    how = F.when(F.col("held").isNotNull(), "identity").when(F.col("named").isNotNull(), "login").otherwise("new")
    rows = rows.select("*", F.coalesce("held", "named", "made", own).alias("cntrb_id"), how.alias("how"))
    changed = rows.filter("how <> 'identity'")
    new = changed.groupBy("cntrb_id").agg(F.min_by("first_login", F.struct("seen", "platform_id", "user_id")).alias("login"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seen", c))).alias(o) for c, o in (("email", "email"), ("name", "full_name"))))
    people = upsert(contributors, new.withColumn("canonical", F.lit(None).cast("string")), ["cntrb_id"], ["email", "full_name"], ("email", "full_name"))
    known = insert_absent(identities, changed.select("platform_id", "user_id", "cntrb_id", "login", "name", "email"), ["platform_id", "user_id"])
    return People(rows.select("platform_id", "user_id", "cntrb_id", "how"), people, known)


def update_resolved(contributors: DataFrame, resolved: DataFrame) -> DataFrame:
    """resolved: cntrb_id, login, email (of commits), one row for each id. Create or update by id, else by login.

    A row of the id takes the login; one that only has the login keeps its id. An empty canonical address is filled.
    """
    names = login_ids(contributors).select("login", F.col("cntrb_id").alias("named"))
    ids = contributors.select("cntrb_id", F.lit(True).alias("same"))
    rows = resolved.join(ids, "cntrb_id", "left").join(names, "login", "left")
    rows = rows.withColumn("cntrb_id", F.when(F.col("same") | F.col("named").isNull(), F.col("cntrb_id")).otherwise(F.col("named")))
    # Several new ids that meet in one contributor, or are new with one login: the least of them.
    rows = rows.groupBy("cntrb_id").agg(F.min("login").alias("login"), F.min(_text("email")).alias("canonical"))
    taken = rows.groupBy("login").agg(F.min("cntrb_id").alias("least"), F.bool_or(F.lit(True)).alias("any"))
    old = contributors.select("cntrb_id", F.lit(True).alias("old"))
    rows = rows.join(taken, "login", "left").join(old, "cntrb_id", "left").filter("old or login is null or cntrb_id = least").drop("least", "any", "old")
    both = contributors.alias("a").join(rows.alias("b"), "cntrb_id", "full_outer")
    return both.select("cntrb_id", F.coalesce(_text("b.login"), F.col("a.login")).alias("login"), "a.email", "a.full_name", F.coalesce(_text("a.canonical"), F.col("b.canonical")).alias("canonical"))


def resolve_addresses(emails: DataFrame, contributors: DataFrame, aliases: DataFrame, identities: DataFrame, platform_id: int = 1) -> DataFrame:
    """email, cntrb_id, how of each distinct address: bot; the number or login in a noreply address; own or canonical address; alias; none."""
    e = emails.filter(_text("email").isNotNull()).select("email").distinct()
    e = e.select("email", _text(S.noreply_login(F.col("email"))).alias("login"), S.noreply_id(F.col("email")).cast("long").alias("user_id"))
    least = lambda df, key, name: df.filter(_text(key).isNotNull()).groupBy(F.col(key).alias(name if name in ("login", "user_id") else "email")).agg(F.min("cntrb_id").alias(f"by_{name}"))
    numbers = identities.filter(F.col("platform_id") == platform_id).groupBy("user_id").agg(F.min("cntrb_id").alias("by_user_id"))
    own = contributors.select("cntrb_id", F.explode(F.array("email", "canonical")).alias("address"))
    out = e.join(numbers, "user_id", "left").join(least(contributors, "login", "login"), "login", "left").join(least(own, "address", "address"), "email", "left").join(least(aliases, "alias_email", "alias"), "email", "left")
    bot = S.is_bot(F.col("email"))
    steps = {"noreply": F.coalesce("by_user_id", "by_login"), "address": F.col("by_address"), "alias": F.col("by_alias")}
    how = F.when(bot, "bot")
    for name, found in steps.items():
        how = how.when(found.isNotNull(), name)
    return out.select("email", F.when(~bot, F.coalesce(*steps.values())).alias("cntrb_id"), how.otherwise("none").alias("how"))


def add_aliases(aliases: DataFrame, resolved: DataFrame, contributors: DataFrame) -> DataFrame:
    """A new alias for each resolved address (email, cntrb_id) that is not its contributor's canonical one; known aliases stay."""
    canonical = contributors.select("cntrb_id", _text("canonical").alias("canonical"))
    new = resolved.filter("cntrb_id is not null").join(canonical, "cntrb_id", "left").filter(~F.col("email").eqNullSafe(F.col("canonical")))
    return insert_absent(aliases, new.select(F.col("email").alias("alias_email"), "cntrb_id", F.coalesce("canonical", "email").alias("canonical_email")), ["alias_email"])


def add_unresolved(unresolved: DataFrame, resolved: DataFrame) -> DataFrame:
    """Addresses that no step resolved, once each."""
    return insert_absent(unresolved, resolved.filter("how = 'none'").select("email"), ["email"])


def back_fill(commits: DataFrame, resolved: DataFrame) -> DataFrame:
    """Commits with the contributor of their author's address where they have none (author_cntrb)."""
    return commits.join(resolved.select(F.col("email").alias("author_email"), F.col("cntrb_id").alias("__found")), "author_email", "left").withColumn("author_cntrb", F.coalesce("author_cntrb", "__found")).drop("__found")
