"""Scalar functions as native column expressions. Empty strings and nulls both mean missing unless said otherwise."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical licence ids and their synonyms (matched without case).
LICENCE_SYNONYMS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat", "Expat License"),
    "Apache-2.0": ("Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License 2.0", "Apache License v2.0", "Apache License Version 2.0", "Apache2", "Apache 2", "ASL 2.0", "Apache Software License", "Apache License"),
    "BSD-3-Clause": ("BSD 3-Clause", "BSD 3-Clause License", "BSD-3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD 3 Clause", "BSD", "BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD 2 Clause"),
    "GPL-2.0-only": ("GPL-2.0", "GPLv2", "GNU General Public License v2.0", "GNU GPL v2", "GPL 2.0", "GPL2"),
    "GPL-3.0-only": ("GPL-3.0", "GPLv3", "GNU General Public License v3.0", "GNU GPL v3", "GPL 3.0", "GPL3"),
    "LGPL-2.1-only": ("LGPL-2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0-only": ("LGPL-3.0", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "AGPL-3.0-only": ("AGPL-3.0", "GNU Affero General Public License v3.0", "AGPLv3"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0",),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "CDDL-1.0": ("CDDL 1.0", "Common Development and Distribution License"),
    "Artistic-2.0": ("Artistic License 2.0", "Perl Artistic License 2.0"),
    "Unlicense": ("The Unlicense", "Unlicence"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "0BSD": ("Zero-Clause BSD", "Free Public License 1.0.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License 1.0", "BSL 1.0"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License", "PSF", "PSFL"),
}
#: Ids with OSI approval.
OSI = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "AGPL-3.0-only", "Artistic-2.0", "Zlib", "Unlicense", "0BSD", "BSL-1.0", "PostgreSQL", "OFL-1.1", "NCSA", "MulanPSL-2.0", "EUPL-1.2", "CC0-1.0", "BlueOak-1.0.0", "UPL-1.0", "PSF-2.0",
)
#: Strings that mean no licence.
NO_LICENCE = ("", "NOASSERTION", "NONE", "N/A", "(NONE)", "UNKNOWN")
#: Public mail providers.
PUBLIC_DOMAINS = (
    "gmail.com", "yahoo.com", "yahoo.co.in", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "msn.com", "protonmail.com", "proton.me", "icloud.com", "me.com", "aol.com", "mail.com", "zoho.com",
    "yandex.ru", "yandex.com", "qq.com", "163.com", "126.com", "sina.com", "foxmail.com", "gmx.com", "gmx.de", "web.de", "mail.ru", "pm.me", "tutanota.com", "fastmail.com", "users.noreply.github.com",
)
NOREPLY = "users.noreply.github.com"
#: Prefix of the classifiers that name a licence, and what names hold, in order of precedence.
CLASSIFIER = "License :: OSI Approved :: "
CLASSIFIED = (
    ("MIT", "MIT"), ("Apache", "Apache-2.0"), ("GPLv3", "GPL-3.0"), ("GPLv2", "GPL-2.0"), ("GNU General Public License v3", "GPL-3.0"), ("GNU General Public License v2", "GPL-2.0"),
    ("GNU Lesser General Public License", "LGPL"), ("BSD", "BSD"), ("ISC", "ISC"), ("Mozilla Public License 2.0", "MPL-2.0"), ("Eclipse", "EPL"), ("Artistic", "Artistic"), ("Zlib", "Zlib"), ("Unlicense", "Unlicense"),
)
#: Kinds of error and the class of each; other errors are fatal.
ERROR_CLASSES = {"canceled": "transient", "deadline exceeded": "transient", "not modified": "not_modified", "not found": "skip", "forbidden": "skip", "gone": "skip", "wrong entity kind": "skip", "all keys invalidated": "auth"}
#: Phrases that identify a full licence text, in order of precedence: all of, none of.
FULL_TEXTS = (
    ("MIT", ("permission is hereby granted, free of charge", 'the software is provided "as is"'), ()),
    ("ISC", ("permission to use, copy, modify, and/or distribute",), ("redistribution",)),
    ("PSF-2.0", ("python software foundation license",), ()),
    ("BSD-3-Clause", ("redistribution and use in source and binary forms", "neither the name"), ()),
    ("BSD-2-Clause", ("redistribution and use in source and binary forms",), ("neither the name",)),
    ("Apache-2.0", ("apache license", "2.0"), ()),
    ("GPL-3.0-only", ("gnu general public license", "version 3"), ()),
    ("GPL-2.0-only", ("gnu general public license", "version 2"), ()),
    ("MPL-2.0", ("mozilla public license", "2.0"), ()),
    ("Unlicense", ("this is free and unencumbered software",), ()),
    ("CC0-1.0", ("creative commons", "cc0"), ()),
    ("CC0-1.0", ("creative commons", "public domain"), ()),
)


def _synonyms() -> dict[str, str]:
    return {s.lower(): spdx for spdx, names in LICENCE_SYNONYMS.items() for s in (spdx, *names)}


def licence_text_id(text: Column) -> Column:
    """Licence id of a full licence text; null if no phrase tells."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for spdx, having, lacking in reversed(FULL_TEXTS):
        test = F.lit(True)
        for p in having:
            test = test & low.contains(p)
        for p in lacking:
            test = test & ~low.contains(p)
        out = F.when(test, F.lit(spdx)).otherwise(out)
    return out


def licence_cut(text: Column, limit: int = 80) -> Column:
    """The first line, sentence or part before a copyright notice if it ends before the limit; else cut with an ellipsis."""
    out = F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))
    for stop in reversed(("\n", ". ", " Copyright")):
        at = F.locate(stop, text)
        out = F.when((at > 1) & (at <= limit), F.substring(text, F.lit(1), at - 1)).otherwise(out)
    return out


def spdx(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    known = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable(_synonyms().items())])
    return (
        F.when(F.upper(t).isin(*NO_LICENCE), F.lit("Unknown"))
        .when(known[F.lower(t)].isNotNull(), known[F.lower(t)])
        .when(F.octet_length(t) > 80, F.coalesce(licence_text_id(t), licence_cut(t)))
        .otherwise(t)
    )


def classifier_licence(classifiers: Column) -> Column:
    """Licence of the first classifier that names one; its name without `` License`` if no rule fits; empty without any."""
    name = F.replace(F.try_element_at(F.filter(classifiers, lambda c: c.startswith(CLASSIFIER)), F.lit(1)), F.lit(CLASSIFIER), F.lit(""))
    out = F.regexp_replace(name, " License$", "")
    for held, licence in reversed(CLASSIFIED):
        out = F.when(name.contains(held), licence).otherwise(out)
    return F.coalesce(out, F.lit(""))


def error_class(kind: Column) -> Column:
    """What to do about an error of a kind: ok (null), transient, not_modified, skip, auth or fatal."""
    known = F.create_map(*[F.lit(x) for pair in ERROR_CLASSES.items() for x in pair])
    return F.when(kind.isNull(), "ok").otherwise(F.coalesce(known[F.lower(kind)], F.lit("fatal")))


def is_osi(licence: Column) -> Column:
    return licence.isin(*OSI)


def email_domain(email: Column) -> Column:
    """Lower-cased part after the last at-sign; empty without one."""
    return F.when(email.contains("@"), F.lower(F.substring_index(email, "@", -1))).otherwise(F.lit(""))


def is_public_domain(domain: Column) -> Column:
    return F.lower(domain).isin(*PUBLIC_DOMAINS)


def company(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    org = F.regexp_extract(t, r"^@(\S*)", 1)
    return (
        F.when(F.lower(t).isin("none", "n/a", "null"), F.lit(""))
        .when(t.startswith("@"), F.concat(F.upper(F.substring(org, 1, 1)), F.substring(org, 2, 1 << 30)))
        .otherwise(t)
    )


def noreply_login(email: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(email), r"^(?:\d+\+)?([^@+]+)@users\.noreply\.github\.com$", 1), F.lit(""))


def noreply_id(email: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(email), r"^(\d+)\+[^@]+@users\.noreply\.github\.com$", 1), F.lit("")).try_cast("long")


def is_bot(email: Column) -> Column:
    low = F.lower(email)
    return low.contains("[bot]") | (low.contains("noreply") & ~low.contains(NOREPLY)) | (low.endswith("@github.com") & ~low.contains("users.noreply"))


def person_uuid(platform: Column, user_id: Column) -> Column:
    """Deterministic UUID: platform byte, then the id in four bytes if it fits, else in eight."""
    hexed = F.lpad(F.hex(user_id), 16, "0")
    body = F.when((user_id >= 0) & (user_id < 1 << 32), F.rpad(F.substring(hexed, 9, 8), 30, "0")).otherwise(F.rpad(hexed, 30, "0"))
    h = F.lower(F.concat(F.lpad(F.hex(platform), 2, "0"), body))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def sanitise(text: Column) -> Column:
    """Without C0 controls (but tab, line feed, carriage return), DEL and C1 controls."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def sanitise_bytes(data: Column) -> Column:
    return sanitise(F.call_function("make_valid_utf8", data.cast("string")))


def strip_json_nul(text: Column) -> Column:
    r"""Without ``\u0000`` escapes; one after an odd run of backslashes is an escaped backslash and stays."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


def version_clean(raw: Column) -> Column:
    """The first version of a range without its operators, each of which is taken off once, in a fixed order."""
    first = F.trim(F.regexp_extract(F.trim(raw), r"^([^,|]+|[,|].*|)", 1))
    return F.trim(F.regexp_replace(first, r"^\^?(?:~=)?~?(?:>=)?(?:<=)?(?:==)?(?:!=)?>?<?=?", ""))


def version_pad(v: Column) -> Column:
    parts = F.slice(F.concat(F.split(v, r"\."), F.array(F.lit("0"), F.lit("0"))), 1, 3)
    return F.when((v == "") | v.contains("-") | v.contains("+"), v).otherwise(F.array_join(parts, "."))


def libyear(current: Column, latest: Column) -> Column:
    """Years between two release times; 0 where either does not parse."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")
    parse = lambda c: F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in forms))
    return F.coalesce((F.unix_micros(parse(latest)) - F.unix_micros(parse(current))) / 86_400e6 / 365, F.lit(0.0))


def cvss_score(vector: Column) -> Column:
    has = lambda *p: F.lit(True) if not p else vector.contains(p[0]) & has(*p[1:])
    return (
        F.when(has("AV:N", "AC:L", "C:H", "I:H", "A:H"), 9.8)
        .when(has("AV:N", "AC:L") & (has("C:H") | has("I:H")), 7.5)
        .when(has("AV:N", "AC:L"), 5.3)
        .when(has("AV:N"), 6.5)
        .when(has("AV:L"), 4.0)
        .otherwise(5.0)
    )


def cvss_label(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("UNKNOWN")


def pick_cve(aliases: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(1)), F.lit(""))


def pick_vector(severity: Column) -> Column:
    return F.try_element_at(F.filter(severity, lambda s: s["type"].isin("CVSS_V3", "CVSS_V3_1")), F.lit(1))["score"]


def first_event(affected: Column, package: Column, what: str) -> Column:
    """First non-empty ``introduced`` or ``fixed`` of the package's ranges; empty if none."""
    mine = F.filter(affected, lambda a: (a["package"]["name"] == package) | (package == ""))
    events = F.flatten(F.flatten(F.transform(mine, lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    return F.coalesce(F.try_element_at(F.filter(F.transform(events, lambda e: e[what]), lambda v: v != ""), F.lit(1)), F.lit(""))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def package_id(name: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat(name, F.lit("@"), version), 256), 1, 16)


def repo_url(url: Column) -> Column:
    """Trimmed, without trailing slashes, ``.git`` and list pages."""
    t = F.regexp_replace(F.trim(url), r"/+$", "")
    t = F.regexp_replace(t, r"/(issues|pulls)$", "")
    return F.regexp_replace(t, r"\.git$", "")


def repo_name(name: Column) -> Column:
    """Trimmed, without one trailing slash, then without ``.git``."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"/\z", ""), r"\.git\z", "")


def repo_address(url: Column) -> Column:
    """Without one trailing slash, then without ``.git``."""
    return F.regexp_replace(F.regexp_replace(url, r"/\z", ""), r"\.git\z", "")


def url_platform(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.contains("github"), "github").when(host.contains("gitlab"), "gitlab").otherwise("generic")


def url_owner(url: Column) -> Column:
    path = F.trim(F.coalesce(F.try_parse_url(repo_url(url), F.lit("PATH")), F.lit("")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def url_repo(url: Column) -> Column:
    return F.regexp_extract(repo_url(url), r"([^/]+)$", 1)


def safe_git_url(url: Column) -> Column:
    return url.rlike(r"^(https?|git|ssh)://[^\x00-\x20\x7F]+$") & ~url.contains("::")


def trailing_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(\d+)$", 1), F.lit("")).try_cast("long")


def diff_counts(diff: Column, sign: str) -> Column:
    head = sign * 3
    return F.size(F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(head)))


def gap_percent(gathered: Column, metadata: Column) -> Column:
    return F.when(metadata == 0, 0.0).otherwise((metadata - gathered) / metadata * 100)


def shard_count(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / F.nullif(F.greatest(size, F.lit(0)), F.lit(0))), F.lit(1))


def first_copyright(json: Column, limit: int = 120) -> Column:
    values = F.from_json(json, "array<struct<value string>>")
    n, first = F.size(values), ellipsis(F.try_element_at(values, F.lit(1))["value"], limit)
    return F.when(F.coalesce(n, F.lit(0)) < 1, F.lit("")).when(n == 1, first).otherwise(F.concat(first, F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)")))


def without_bad_times(df, columns: list[str], year: int = 1970, instead: Column | None = None):
    """The frame with times before the year as null, or as ``instead`` where a column may not be null."""
    return df.withColumns({c: F.when(F.year(c) >= year, F.col(c)).when(F.col(c).isNotNull(), instead) for c in columns})


def register(spark) -> None:
    """Expose the row functions under SQL names where SQL text can express them."""
    spark.sql("create or replace temporary function pg_email_domain(e string) returns string return case when contains(e, '@') then lower(substring_index(e, '@', -1)) else '' end")
    spark.sql("create or replace temporary function pg_cvss_label(s double) returns string return case when s >= 9 then 'CRITICAL' when s >= 7 then 'HIGH' when s >= 4 then 'MEDIUM' when s > 0 then 'LOW' else 'UNKNOWN' end")
