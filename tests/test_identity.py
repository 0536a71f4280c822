"""Accounts and addresses resolved in sets, against one row after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import identity as I

PEOPLE = "cntrb_id string, login string, email string, full_name string, canonical string"
KNOWN = "platform_id int, user_id long, cntrb_id string, login string, name string, email string"
SEEN = "seq long, platform_id int, user_id long, login string, name string, email string"


def uuid(spark, platform, user):
    return spark.range(1).select(S.person_uuid(F.lit(platform), F.lit(user).cast("long"))).first()[0]


def one_by_one(spark, sightings, people, known):
    """Identity, else login, else create: the rows in order, as a server would take them."""
    identities, logins, out = {(p, u): c for p, u, c, *_ in known}, {}, {}
    for c, login, *_ in sorted(people):
        if login:
            logins.setdefault(login, c)
    first = {}
    for _, p, u, login, *_ in sorted(sightings, key=lambda r: r[0]):
        if u and u > 0 and login and (p, u) not in first:
            first[p, u] = login
    for _, p, u, *_ in sorted(sightings, key=lambda r: r[0]):
        if u and u > 0 and (p, u) not in out:
            login = first.get((p, u))
            how = "identity" if (p, u) in identities else "login" if login in {x[1] for x in people if x[1]} else "new"
            c = identities.get((p, u)) or logins.get(login) or uuid(spark, p, u)
            if login:
                logins.setdefault(login, c)
            out[p, u] = (c, how)
    return out


def test_accounts(spark):
    r = random.Random(6)
    people = [(f"c{i}", f"l{i}" if i % 2 else "", "", None, None) for i in range(6)]
    known = [(1, 1, "c0", "x", None, None), (2, 1, "c1", None, None, None)]
    sightings = [(seq, r.choice([1, 2]), r.choice([0, None, *range(1, 9)]), r.choice(["", None, "l1", "l3", "new", "other"]), r.choice(["", "Ann"]), r.choice(["", f"{seq}@x"])) for seq in range(60)]
    got = I.resolve_accounts(spark.createDataFrame(sightings, SEEN), spark.createDataFrame(people, PEOPLE), spark.createDataFrame(known, KNOWN))
    want = one_by_one(spark, sightings, people, known)
    assert {(x.platform_id, x.user_id): (x.cntrb_id, x.how) for x in got.accounts.collect()} == want
    after = {x.cntrb_id: x for x in got.contributors.collect()}
    assert after.keys() == {p[0] for p in people} | {c for c, _ in want.values()}
    assert {(x.platform_id, x.user_id): x.cntrb_id for x in got.identities.collect()} == {k: c for k, (c, _) in want.items()} | {(1, 1): "c0", (2, 1): "c1"}
    again = I.resolve_accounts(spark.createDataFrame(sightings, SEEN), spark.createDataFrame(list(after.values()), PEOPLE), got.identities)
    assert {x.how for x in again.accounts.collect()} == {"identity"}


def test_create_or_update_by_id_else_login(spark):
    people = spark.createDataFrame([("a", "old", "a@x", "A", ""), ("b", "bob", None, None, "b@x")], PEOPLE)
    resolved = spark.createDataFrame([("a", "new", "a@c"), ("z", "bob", "z@c"), ("y", "yan", "y@c"), ("x", "yan", "x@c")], "cntrb_id string, login string, email string")
    got = sorted(tuple(r) for r in I.update_resolved(people, resolved).na.fill("-").collect())
    assert got == [("a", "new", "a@x", "A", "a@c"), ("b", "bob", "-", "-", "b@x"), ("x", "yan", "-", "-", "x@c")]


def test_addresses_aliases_and_unresolved(spark):
    people = spark.createDataFrame([("a", "ann", "a@x", None, "a@x"), ("b", "bob", "", None, "b@x")], PEOPLE)
    known = spark.createDataFrame([(1, 42, "b", None, None, None)], KNOWN)
    aliases = spark.createDataFrame([("b2@x", "b", "b@x")], "alias_email string, cntrb_id string, canonical_email string")
    emails = spark.createDataFrame([(x,) for x in ("a@x", "b@x", "b2@x", "42+gone@users.noreply.github.com", "ann@users.noreply.github.com", "who@x", "who@x", "", None, "ci[bot]@users.noreply.github.com")], "email string")
    found = I.resolve_addresses(emails, people, aliases, known)
    got = {r.email: (r.cntrb_id, r.how) for r in found.collect()}
    assert got == {"a@x": ("a", "address"), "b@x": ("b", "address"), "b2@x": ("b", "alias"), "42+gone@users.noreply.github.com": ("b", "noreply"), "ann@users.noreply.github.com": ("a", "noreply"), "who@x": (None, "none"), "ci[bot]@users.noreply.github.com": (None, "bot")}
    assert sorted(tuple(r) for r in I.add_aliases(aliases, found, people).collect()) == [("42+gone@users.noreply.github.com", "b", "b@x"), ("ann@users.noreply.github.com", "a", "a@x"), ("b2@x", "b", "b@x")]
    none = spark.createDataFrame([("who@x",), ("else@x",)], "email string")
    assert sorted(r.email for r in I.add_unresolved(none, found).collect()) == ["else@x", "who@x"]
    commits = spark.createDataFrame([("h1", "a@x", None), ("h2", "a@x", "k"), ("h3", "who@x", None)], "hash string, author_email string, author_cntrb string")
    assert sorted((r["hash"], r["author_cntrb"]) for r in I.back_fill(commits, found).collect()) == [("h1", "a"), ("h2", "k"), ("h3", None)]
