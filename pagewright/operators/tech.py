"""Technology: trackers, platform, verifications, social profiles, security grade, summary and findings.

Signatures are unrolled into the expression, one alternation a tracker, so each is compiled once and no
join or Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import catalogue as C
from pagewright.operators.findings import Rule
from pagewright.operators.rules import findings_of, ld_nodes

#: An ASCII word boundary, whatever letters stand beside it.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
TRACKER = "array<struct<key:string,name:string,category:string,ids:array<string>,sources:array<string>,dead:string>>"


def java(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def found(text: Column, pattern: str, case: bool = False) -> Column:
    return F.coalesce(text, F.lit("")).rlike(("" if case else "(?i)") + java(pattern))


def literal(pattern: str) -> str | None:
    """The longest run of plain characters, in lower case, that every match of pattern has; null if there is none of three or more."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        plain = None
        if c == "\\":
            i += 1
            plain = pattern[i] if not pattern[i].isalnum() else None
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            return None
        elif c in "?*{":
            if run:
                runs.append(run[:-1])
                run = ""
            if c == "{":
                i = pattern.index("}", i)
        elif c not in "|.^$+":
            plain = c
        if plain is not None and not depth and plain.isascii():
            run += plain
        elif c not in "?*{":
            runs.append(run)
            run = ""
        i += 1
    best = max([*runs, run], key=len).lower()
    return best if len(best) >= 3 else None


def trackers(sources: dict[str, Column]) -> Column:
    """Trackers of a page, by category then name: where each was seen, and its ids (ten at most) in those places.

    A text is searched for a pattern only if it holds the plain characters that the pattern needs.
    """
    labels = list(sources)
    texts = F.array(F.struct(*(x for i, label in enumerate(labels) for x in (F.coalesce(sources[label], F.lit("")).alias(f"t{i}"), F.lower(F.coalesce(sources[label], F.lit(""))).alias(f"low{i}")))))

    def rows(s: Column) -> Column:
        out = []
        for key, name, category, patterns, ids in sorted(C.TRACKERS, key=lambda t: (C.CATEGORIES.index(t[2]), t[1].lower())):
            needs = [literal(p) for p in patterns]
            hit = {}
            for i, label in enumerate(labels):
                match = found(s[f"t{i}"], "|".join(f"(?:{p})" for p in patterns))
                if all(needs):
                    may = None
                    for x in dict.fromkeys(needs):
                        may = s[f"low{i}"].contains(x) if may is None else may | s[f"low{i}"].contains(x)
                    match = F.when(may, match).otherwise(False)
                hit[label] = match
            once = F.array(F.struct(*(h.alias(f"h{i}") for i, h in enumerate(hit.values()))))  # each text is searched once, whatever asks for the answer

            def row(h: Column) -> Column:
                seen = F.array_compact(F.array(*(F.when(h[f"h{i}"], F.lit(label)) for i, label in enumerate(labels))))  # noqa: B023
                each = [F.when(h[f"h{i}"], F.regexp_extract_all(s[f"t{i}"], F.lit(java(p)), F.lit(1))).otherwise(F.array().cast("array<string>")) for i in range(len(labels)) for p in ids]  # noqa: B023
                own = F.slice(F.array_distinct(F.filter(F.concat(*each), lambda x: x != "")), 1, 10) if each else F.array().cast("array<string>")
                return F.when(F.size(seen) > 0, F.struct(F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(category).alias("category"), own.alias("ids"), seen.alias("sources"), F.lit(C.DEAD.get(key, "")).alias("dead")))  # noqa: B023

            out.append(F.transform(once, row)[0])
        return F.array_compact(F.array(*out)).cast(TRACKER)

    return F.transform(texts, rows)[0]


def platform(html: Column, generator: Column, headers: Column) -> Column:
    """cms, detail (in order), generator, server, poweredBy."""
    generator = F.coalesce(generator, F.lit(""))
    cms = F.lit(None).cast("string")
    for pattern, name, case in reversed(C.PLATFORMS):
        cms = F.when(found(html, pattern, case), name).otherwise(cms)
    theme = lambda p: F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), p, 1), F.lit(""))
    word, shop = cms.eqNullSafe("WordPress"), cms.eqNullSafe("Shopify")
    details = [
        F.when(word & F.lower(generator).startswith("wordpress"), generator),
        F.when(word, F.concat(F.lit("Theme: "), theme(C.WORDPRESS_THEME))),
        *(F.when(word & found(html, p), F.lit(label)) for p, label in C.WORDPRESS_DETAILS),
        F.when(shop, F.concat(F.lit("Theme: "), theme(C.SHOPIFY_THEME))),
        *(F.when(found(html, p, True), F.lit(f"Framework: {label}")) for p, label in C.FRAMEWORKS),
    ]
    lower = F.transform_keys(headers, lambda k, v: F.lower(k))
    return F.struct(F.coalesce(cms, generator).alias("cms"), F.array_distinct(F.array_compact(F.array(*details))).alias("detail"), generator.alias("generator"), F.coalesce(F.try_element_at(lower, F.lit("server")), F.lit("")).alias("server"), F.coalesce(F.try_element_at(lower, F.lit("x-powered-by")), F.lit("")).alias("poweredBy"))


def verifications(other_meta: Column) -> Column:
    rows = [F.when(F.map_contains_key(other_meta, key), F.struct(F.lit(label).alias("platform"), F.lit(key).alias("meta"), F.left(F.try_element_at(other_meta, F.lit(key)), F.lit(60)).alias("value"))) for key, label in C.VERIFICATIONS]
    return F.array_compact(F.array(*rows))


def socials(s: Column) -> Column:
    """The first profile of each platform: links first, then what structured data names."""
    named = F.flatten(F.transform(ld_nodes(s), lambda n: n["sameAs"]))
    urls = F.concat(F.array_compact(F.transform(s["links"], lambda x: x["href"])), named)
    hosts = F.create_map(*(F.lit(x) for pair in C.SOCIALS.items() for x in pair))
    platform_of = lambda u: F.try_element_at(hosts, F.coalesce(F.regexp_replace(T.host_of(u), r"^www\.", ""), F.lit("")))
    known = F.filter(F.transform(F.filter(urls, lambda u: ~found(u, C.NO_PROFILE)), lambda u: F.struct(platform_of(u).alias("platform"), u.alias("url"))), lambda x: x["platform"].isNotNull())
    names = F.array_distinct(F.transform(known, lambda x: x["platform"]))
    return F.transform(names, lambda p: F.struct(p.alias("platform"), F.try_element_at(F.filter(known, lambda x: x["platform"] == p), F.lit(1))["url"].alias("url")))


def security(headers: Column, https: Column) -> Column:
    """grade, present, missing; null where no headers are known."""
    keys = F.transform(F.map_keys(headers), F.lower)
    row = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(label).alias("label")) for k, label in C.SECURITY_HEADERS))
    names = lambda test: F.transform(F.filter(row, test), lambda x: x["label"])
    present, missing = names(lambda x: F.array_contains(keys, x["k"])), names(lambda x: ~F.array_contains(keys, x["k"]))
    n = F.size(present) + F.when(https, 1).otherwise(0)
    grade = F.when(n >= 7, "A+").when(n >= 6, "A").when(n >= 5, "B").when(n >= 4, "C").when(n >= 2, "D").otherwise("F")
    return F.when(F.coalesce(F.size(headers), F.lit(0)) > 0, F.struct(grade.alias("grade"), https.alias("https"), present.alias("present"), missing.alias("missing")))


def container_urls(found_trackers: Column) -> Column:
    """Addresses of tag containers worth fetching, five at most."""
    own = F.filter(found_trackers, lambda t: t["key"].isin("gtm", "ga4", "google_ads"))
    ids = F.flatten(F.transform(own, lambda t: t["ids"]))
    base = "https://www.googletagmanager.com"
    urls = F.transform(ids, lambda i: F.when(i.startswith("GTM-"), F.concat(F.lit(f"{base}/gtm.js?id="), i)).when(i.startswith("G-"), F.concat(F.lit(f"{base}/gtag/js?id="), i)))
    return F.slice(F.array_distinct(F.array_compact(urls)), 1, 5)


def summary(found_trackers: Column, hosts: Column) -> Column:
    n = F.size(found_trackers)
    level = F.when(n >= 12, "heavy").when(n >= 5, "moderate").when(n >= 1, "light").otherwise("none")
    return F.struct(level.alias("level"), n.alias("trackers"), F.size(F.filter(found_trackers, lambda t: t["category"] == "advertising")).alias("ads"), F.size(F.filter(found_trackers, lambda t: t["dead"] != "")).alias("dead"), F.size(F.filter(hosts, lambda h: h["thirdParty"])).alias("thirdParty"))


def tech_rules(found_trackers: Column, grade: Column) -> list[Rule | Column]:
    a, t = "tech", found_trackers
    runtime = F.filter(t, lambda x: (F.size(x["sources"]) == 1) & (x["sources"][0] == "requests"))
    return [
        findings_of(F.filter(t, lambda x: x["dead"] != ""), lambda x: ("warn", a, F.concat(F.lit("tech.dead."), x["key"]), F.concat(x["name"], F.lit(" no longer works")), F.concat(F.lit("since "), x["dead"]), "Remove the tag.")),
        findings_of(F.filter(t, lambda x: F.size(x["ids"]) > 1), lambda x: ("warn", a, F.concat(F.lit("tech.dupe."), x["key"]), F.concat(x["name"], F.lit(" has several ids")), F.array_join(x["ids"], ", "), "Keep the one in use.")),
        Rule(a, "tech.runtime-only", "note", F.size(runtime) > 0, "Seen in requests only", F.array_join(F.transform(runtime, lambda x: x["name"]), ", ")),
        Rule(a, "tech.security", "warn", F.coalesce(grade["grade"].isin("D", "F"), F.lit(False)), F.concat(F.lit("Security headers: grade "), grade["grade"]), F.array_join(grade["missing"], ", "), "Add the missing headers."),
        Rule(a, "tech.no-analytics", "note", ~F.exists(t, lambda x: x["category"] == "analytics"), "Nothing measures visits"),
    ]
