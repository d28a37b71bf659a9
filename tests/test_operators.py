"""Operators against brute force on small tables with one very large site."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitelore.functions import vocab as V
from sitelore.functions.scale import first_many_per_group, project_wanted, salted_join
from sitelore.operators import (
    answers, clusters, company, content, costs, discovery, document, elements, links, parts, prefilter, runs, sections,
)
from sitelore.plans import knowledge_base
from sitelore.sources import sinks, tables

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


# --- scale helpers --------------------------------------------------------------------------
def test_salted_join_is_an_ordinary_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    keys = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = salted_join(rows, keys, ["k"], how)
        b = rows.join(keys, "k", how).select(*a.columns)
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_first_many_per_group_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 4 > 0, 0).otherwise(F.col("id") % 7).alias("g"), F.hash("id").alias("o"))
    got = first_many_per_group(df, ["g"], [F.col("o")], 1500).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.g].append(r.o)
    want = {(g, o, i) for g, os in groups.items() for i, o in enumerate(sorted(os)[:1500], 1)}
    assert {(r.g, r.o, r["rank"]) for r in got} == want


def test_only_wanted_rows_are_projected(spark):
    pages = spark.range(300_000).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), "id").alias("html"))
    wanted = spark.range(0, 300_000, 1).filter("id <> 7").select(F.col("id").alias("page_id"), (F.col("id") + 1).alias("rank"))
    read = lambda rows: rows.withColumn("n", F.expr("length(html)")).drop("html")
    got = project_wanted(pages, wanted, "page_id", read)
    assert got.count() == 299_999 and got.filter("rank <> page_id + 1 OR n <> length(page_id) + 3").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("length(html") < plan.index("Join")  # the projection stands above the join


# --- candidates -----------------------------------------------------------------------------
def candidate_rows(n=1500):
    rnd = random.Random(7)
    kinds = ["/guide-%d", "/category/%d", "/item/%d", "/product/%d", "/how-to/%d", "/x%d.pdf", "/cart/%d", "/tag/%d", "/p%d?page=2", "/product-line-%d", "/about-%d", "/help%d"]
    rows = []
    for i in range(n):
        site = "big.example" if rnd.random() < 0.8 else f"s{rnd.randrange(6)}.example"
        url = rnd.choice(["https://", "HTTPS://"]) + site + rnd.choice(kinds) % rnd.randrange(900) + rnd.choice(["", "#top"])
        if rnd.random() < 0.03:
            url = rnd.choice([None, "", "mailto:x@y.zz", "https://other.example/a"])
        if rnd.random() < 0.2:
            url = f"https://{site}/same"
        rows.append((site, i, url))
    return rows


def norm(u):
    u = u.split("#")[0]
    return u.split(":", 1)[0].lower() + ":" + u.split(":", 1)[1]


def brute_prefilter(rows):
    kept, dropped, sample = defaultdict(list), defaultdict(Counter), defaultdict(list)
    seen = set()
    for site, pos, url in rows:
        count = dropped[site]
        if not url:
            count["invalid"] += 1
            continue
        n = norm(url)
        if (site, n) in seen:
            count["duplicate"] += 1
            continue
        seen.add((site, n))
        rest = n.split("//", 1)[-1]
        host, path = rest.split("/", 1)[0], "/" + (rest.split("/", 1) + [""])[1].split("?")[0].lower()
        query = n.split("?", 1)[1].lower() if "?" in n else ""
        reason = (
            "non_http" if not n.startswith("http") else "offsite" if host != site
            else "asset" if path.endswith(tuple(V.ASSET_SUFFIXES))
            else "transactional" if any(w in path for w in V.TRANSACTIONAL_PATHS)
            else "archive" if any(w in path for w in V.ARCHIVE_PATHS)
            else "faceted" if any(w in query for w in V.FACET_QUERIES)
            else "product" if any(w in path for w in V.PRODUCT_PATHS) else None
        )
        if reason == "product":
            sample[site].append((n, pos))
        if reason:
            count[reason] += 1
        else:
            kept[site].append((n, pos, 0))
    for site, items in sample.items():
        kept[site] += [(u, p, 1) for u, p in items[:15]]
        dropped[site]["product"] -= len(items[:15])
    return kept, {(s, r): n for s, c in dropped.items() for r, n in c.items() if n > 0}


@pytest.fixture(scope="module")
def data(spark):
    rows = candidate_rows()
    df = spark.createDataFrame(rows, "site string, pos bigint, url string").repartition(4)
    return df.cache(), *brute_prefilter(rows)


def test_prefilter(data):
    df, kept, dropped = data
    got = prefilter.prefilter_urls(df).select("site", "url", "pos", "tail").collect()
    assert sorted(map(tuple, got)) == sorted((s, *r) for s, rs in kept.items() for r in rs)
    counts = {(r.site, r.reason): r.n for r in prefilter.dropped_by_reason(df).collect()}
    assert counts == dropped
    # nothing is lost: kept + dropped = given
    assert len(got) + sum(counts.values()) == df.count()


def brute_tier(url):
    low = url.lower()
    has = lambda words: any(w in low for w in words)
    return ("skip" if has(V.TIER_SKIP) else "high" if has(V.TIER_HIGH) else "medium" if has(V.TIER_MEDIUM)
            else "low" if has(V.TIER_LOW) else "medium")


def brute_sample(urls):
    if len(urls) <= V.TIER_THRESHOLD:
        return list(urls)
    tiers = defaultdict(list)
    for u in urls:
        tiers[brute_tier(u)].append(u)
    out = tiers["high"][:V.TIER_HIGH_LIMIT]
    for tier, share in (("medium", 2), ("low", 1)):
        free = (V.TIER_THRESHOLD - len(out)) // share
        out = out + sorted(tiers[tier], key=lambda u: (md5(u), u))[:free]
    return out


def brute_clusters(urls):
    return {c: [u for u in urls if any(w in u.lower() for w in ws)]for c, ws in V.CLUSTER_WORDS.items()}


def test_tier_sample_and_clusters(spark, data):
    df, kept, _ = data
    assert len(kept["big.example"]) > V.TIER_THRESHOLD  # the large-site branch is taken
    sample = clusters.tier_quota_sample(prefilter.prefilter_urls(df)).cache()
    got = defaultdict(list)
    for r in sample.orderBy("site", "rank").collect():
        got[r.site].append(r.url)
    want = {s: brute_sample([u for u, *_ in rs]) for s, rs in kept.items()}
    assert got == want
    assigned = defaultdict(list)
    every = prefilter.prefilter_urls(df)
    for r in clusters.cluster_assign(every).orderBy("site", "cluster", "tail", "pos", "url").collect():
        assigned[r.site, r.cluster].append(r.url)
    full = {(s, c): us for s, rs in kept.items() for c, us in brute_clusters([u for u, *_ in rs]).items() if us}
    assert assigned == full and max(map(len, full.values())) > 10
    limited = clusters.cluster_assign(every, 3).groupBy("site", "cluster").count().collect()
    assert {(r.site, r.cluster): r["count"] for r in limited} == {k: min(3, len(us)) for k, us in full.items()}
    counts = {(r.site, r.cluster): r.n for r in clusters.cluster_counts(every).collect()}
    assert {k: n for k, n in counts.items() if n} == {k: len(us) for k, us in full.items()}
    assert clusters.knowledge_tier(every).count() == sum(map(len, kept.values()))


@pytest.mark.parametrize("budget", [1, 25, 80, 300])
def test_selection(spark, data, budget):
    df, kept, _ = data
    homes = {s: f"https://{s}/" for s in kept}
    homes["s1.example"] = kept["s1.example"][3][0]  # a start page that is in the list
    bases = spark.createDataFrame([(s, u, -7) for s, u in homes.items()], "site string, base_url string, page_id bigint")
    got = defaultdict(list)
    for r in clusters.select_pages(bases, prefilter.prefilter_urls(df), budget).orderBy("site", "rank").collect():
        got[r.site].append((r.url, r.cluster))
    for site, rows in kept.items():
        urls = [u for u, *_ in rows]
        if homes[site] not in urls:
            urls.insert(0, homes[site])
        found = brute_clusters(urls)
        order = [(homes[site], "company_information")]
        order += [(u, c) for c in V.CLUSTER_PICK_ORDER for u in found[c]] + [(u, "company_information") for u in urls]
        first = {}
        for u, c in order:
            first.setdefault(u, c)
        want = list(first.items())[:budget]
        assert got[site] == want
        assert got[site][0][0] == homes[site] and len(got[site]) <= budget


def test_budget_per_site(spark, data):
    df, kept, _ = data
    asked = {"big.example": 3, "s0.example": 200, "s1.example": 0}
    bases = spark.createDataFrame(
        [(s, f"https://{s}/", -7, asked.get(s)) for s in kept], "site string, base_url string, page_id bigint, budget int")
    got = Counter(r.site for r in clusters.select_pages(bases, prefilter.prefilter_urls(df)).collect())
    limits = {s: {3: 3, 200: 80}.get(asked.get(s), 25) for s in kept}
    assert got == {s: min(limits[s], len({f"https://{s}/", *(u for u, *_ in rs)})) for s, rs in kept.items()}


def test_page_budget(spark):
    df = spark.createDataFrame([(None,), (0,), (-5,), (1,), (81,), (40,)], "n int")
    assert [r[0] for r in df.select(clusters.page_budget(F.col("n"))).collect()] == [25, 25, 1, 1, 80, 40]


# --- discovery ------------------------------------------------------------------------------
def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("s", "https://s/sitemap.xml", f"<sitemapindex {ns}><sitemap><loc> https://s/a.xml </loc></sitemap><sitemap><loc>https://s/sitemap.xml</loc></sitemap></sitemapindex>"),
        ("s", "https://s/a.xml", "<urlset><url><loc>https://s/p?a=1&amp;b=2</loc></url><url><loc> </loc></url><url><loc>https://s/b.xml</loc></url></urlset>"),
        ("s", "https://s/b.xml", "<urlset><url><loc>https://s/q</loc></url"),
        ("s", "https://s/extra.xml", '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>\thttps://s/r\n</sm:loc></sm:url></sm:urlset>'),
        ("s", "https://s/c.xml", "<urlset><url><loc>https://s/never</loc></url></urlset>"),
    ]
    files = spark.createDataFrame(rows, "site string, sitemap_url string, xml string")
    robots = spark.createDataFrame([("s", "x\r\n \tSiteMap:\t https://s/extra.xml \t\nDisallow: /")], "site string, body string")
    bases = spark.createDataFrame([("s", "https://s/", 1)], "site string, base_url string, page_id bigint")
    start = tables.robots_sitemaps(robots, bases)
    assert {r.sitemap_url for r in start.collect()} == {"https://s/extra.xml", "https://s/sitemap.xml", "https://s/sitemap_index.xml"}
    found = discovery.sitemap_expand(start, tables.sitemap_locs(files))
    assert sorted(tuple(r) for r in found.collect()) == [("s", "https://s/p?a=1&b=2"), ("s", "https://s/r")]


def test_crawl_goes_deep_and_stops_where_a_site_is_full(spark):
    chain = [("a", f"https://a/{i}", f"https://a/{i + 1}") for i in range(12)] + [("b", "https://b/0", f"https://b/{i}") for i in range(1, 30)]
    chain += [("b", f"https://b/{i}", "https://b/deep") for i in range(1, 30)]
    edges = spark.createDataFrame(chain, "site string, src_url string, dst_url string")
    bases = spark.createDataFrame([(s, f"https://{s}/0", 0) for s in "ab"], "site string, base_url string, page_id bigint")
    urls = {(s, u) for s, *us in chain for u in us}
    pages = spark.createDataFrame([(s, u) for s, u in urls], "site string, url string")
    got = discovery.crawl_reach(bases, edges, pages, 10).collect()
    assert sorted(r.depth for r in got if r.site == "a") == list(range(10))
    assert sorted(r.depth for r in got if r.site == "b") == [0] + [1] * 9


def test_reach_has_shortest_depths_and_ends_on_cycles(spark):
    rnd = random.Random(3)
    edges = [("s", f"u{rnd.randrange(40)}", f"u{rnd.randrange(40)}") for _ in range(60)] + [("s", "u0", f"u{i}") for i in range(20, 30)]
    df = spark.createDataFrame(edges, "site string, src_url string, dst_url string")
    start = spark.createDataFrame([("s", "u0")], "site string, url string")
    want, level, depth = {"u0": 0}, {"u0"}, 0
    while level:
        depth += 1
        level = {d for _, s, d in edges if s in level} - set(want)
        want |= dict.fromkeys(level, depth)
    assert {r.url: r.depth for r in discovery.reachable(start, df).collect()} == want
    assert {r.url: r.depth for r in discovery.reachable(start, df, 1).collect()} == {u: d for u, d in want.items() if d <= 1}


def test_discovery_uses_the_crawl_only_where_sitemaps_are_thin(spark):
    bases = spark.createDataFrame([("a", "A"), ("b", "B")], "site string, base_url string")
    maps = spark.createDataFrame([("a", f"u{i}") for i in range(5)] + [("b", "m")], "site string, url string")
    walk = spark.createDataFrame([("a", 1, "w"), ("b", 1, "B"), ("b", 2, "w")], "site string, rank bigint, url string")
    got = discovery.discover_candidates(bases, maps, walk, cap=4).orderBy("site", "pos").collect()
    assert [(r.site, r.pos, r.url) for r in got] == [("a", 0, "A"), ("a", 1, "u0"), ("a", 2, "u1"), ("a", 3, "u2"), ("b", 0, "B"), ("b", 1, "m"), ("b", 2, "B"), ("b", 3, "w")]
    meta = {r.site: tuple(r)[1:] for r in discovery.discovery_meta(bases, maps, walk, cap=4).collect()}
    assert meta == {"a": (5, 0, "sitemap", True), "b": (1, 2, "crawl", False)}


def test_core_pages(spark):
    crawl = spark.createDataFrame([
        ("s", 1, "https://s/about-us/", 200), ("s", 2, "https://s/about-us/?x", 200), ("s", 3, "http://s/faq/", 200),
        ("s", 4, "https://s/terms/", 404), ("s", 5, "https://s/درباره-ما/", 301), ("s", 6, "https://s/about-us/", 200)],
        "site string, page_id bigint, url string, status int")
    bases = spark.createDataFrame([("s", "https://s/", 0)], "site string, base_url string, page_id bigint")
    got = [(r.url, r.title) for r in discovery.core_pages(bases, crawl).orderBy("ord").collect()]
    assert got == [("https://s/", "Main Page"), ("https://s/about-us/", "About Us"), ("https://s/درباره-ما/", "درباره ما")]


# --- sections and documents -----------------------------------------------------------------
def chunk_rows(n=60):
    rnd = random.Random(11)
    keys, rows = list(V.SECTIONS), []
    for i in range(n):
        site = "a" if i % 3 else "b"
        text = "\n".join(rnd.choice(["same line", "Same  LINE", f"line {rnd.randrange(30)}", "w " * rnd.randrange(1, 60)]) for _ in range(rnd.randrange(1, 9)))
        rows.append((site, i, keys[rnd.randrange(3)], text, f"https://{site}/{i}", f"T{i}", "company_information"))
    return rows


@pytest.fixture(scope="module")
def chunks(spark):
    from sitelore.functions import text as T

    df = spark.createDataFrame(chunk_rows(), "site string, pos bigint, section string, chunk string, url string, title string, cluster string")
    return df.withColumn("tokens", F.expr(T.tokens("chunk"))).repartition(4).cache()


def test_token_batches(chunks):
    got = {(r.site, r.section, r.pos): r.batch for r in sections.token_batches(chunks, 60).collect()}
    groups, want = defaultdict(list), {}
    for r in chunks.orderBy("pos").collect():
        groups[r.site, r.section].append((r.pos, r.tokens))
    for key, items in groups.items():
        batch, used = 1, 0
        for pos, t in items:
            if used and used + t > 60:
                batch, used = batch + 1, 0
            used += t
            want[(*key, pos)] = batch
    assert got == want and max(want.values()) > 2


def test_token_batches_of_a_section_of_thousands(spark):
    rows = spark.range(5000).select(F.lit("s").alias("site"), F.lit("faq").alias("section"), F.col("id").alias("pos"), (F.col("id") % 90).alias("tokens"))
    got = [(r.pos, r.batch) for r in sections.token_batches(rows, 700).orderBy("pos").collect()]
    batch, used, want = 1, 0, []
    for pos in range(5000):
        t = max(1, pos % 90)
        if used and used + t > 700:
            batch, used = batch + 1, 0
        used += t
        want.append((pos, batch))
    assert got == want


def test_parts_put_together_are_the_documents(spark, chunks):
    bases = spark.createDataFrame([(s, f"http://{s}/") for s in [*{r.site for r in chunks.select("site").collect()}, "bare", "only"]], "site string, base_url string")
    contacts = spark.createDataFrame([("only", "a@b.co", "+98 21 8877 6655"), ("bare", "", "")], "site string, emails string, phones string")
    first = chunks.agg(F.min("site")).first()[0]
    contacts = contacts.unionByName(spark.createDataFrame([(first, "x@y.zz", "")], contacts.schema))
    languages = spark.createDataFrame([(first, "fa"), ("only", "en")], "site string, lang string")
    bodies = sections.section_docs(sections.section_merge(chunks), contacts)
    whole = {r.site: r.document for r in document.assemble_document(bodies, languages, bases).collect()}
    pieces = parts.document_pieces(chunks, contacts, languages, bases)
    for size in (7, 1000):
        got = defaultdict(str)
        rows = parts.parts_of(pieces, size).orderBy("site", "part").collect()
        for r in rows:
            got[r.site] += r.text
            assert len(r.text) <= size
        assert dict(got) == whole


def test_parts_of_a_site_with_very_many_pages(spark):
    chunk = F.concat(F.lit("Page "), F.col("id").cast("string"), F.lit("\nsaid everywhere\nsecond line "), (F.col("id") % 1000).cast("string"))
    rows = spark.range(40_000).select(
        F.lit("hot").alias("site"), F.lit("faq").alias("section"), F.col("id").alias("pos"), chunk.alias("chunk")
    )
    none = spark.createDataFrame([], "site string, emails string, phones string, lang string")
    bases = spark.createDataFrame([("hot", "http://hot/")], "site string, base_url string")
    made = parts.parts_of(parts.document_pieces(rows, none, none, bases), 5000).cache()
    text = "".join(r.text for r in made.orderBy("part").collect())
    assert made.agg(F.max(F.length("text"))).first()[0] == 5000
    assert text.count("said everywhere") == 1 and text.count("Page ") == 40_000 and text.count("second line") == 1000
    assert text.index("Page 39999") > text.index("Page 39998") > text.index("second line 999") > text.index("Page 0")


def test_left_out_paragraphs_complete_the_condensed_text(spark):
    from sitelore.functions import text as T

    body = "\n".join(f"p{i} " + "x" * 3000 for i in range(40))
    df = spark.createDataFrame([("s", "faq", body), ("s", "contact", "short")], "site string, section string, body string")
    df = df.withColumn("tokens", F.expr(T.tokens("body")))
    kept = document.compression_plan(df, 2000).filter("compress").first()
    rest = [r.para for r in document.left_out(df, 2000).orderBy("no").collect()]
    assert kept.body.split("\n") + rest == body.split("\n") and rest
    assert not document.compression_plan(df).filter("compress").count()


def brute_merge(rows):
    out, seen = defaultdict(list), defaultdict(set)
    for site, pos, section, text, *_ in rows:
        parts = []
        for line in text.split("\n"):
            line = line.strip()
            key = " ".join(line.split()).lower()
            if line and key not in seen[site, section]:
                seen[site, section].add(key)
                parts.append(line)
        if parts:
            out[site, section].append("\n".join(parts))
    return {k: sections.RULE.join(v) for k, v in out.items()}


def test_merge_and_partials_keep_the_same_paragraphs(chunks):
    merged = {(r.site, r.section): r.body for r in sections.section_merge(chunks).collect()}
    assert merged == brute_merge(chunk_rows())
    twice = sections.merge_partials(sections.section_partial(chunks, 60))
    lines = lambda body: [l for l in body.split("\n") if l and l != "---"]
    assert {(r.site, r.section): lines(r.body) for r in twice.collect()} == {k: lines(b) for k, b in merged.items()}


def test_contact_section_appears_for_contacts_alone(spark, chunks):
    contacts = spark.createDataFrame([("z", "a@b.cd", "")], "site string, emails string, phones string")
    rows = {(r.site, r.section): r.n_chunks for r in sections.section_chunks(chunks, contacts).collect()}
    assert rows["z", "contact"] == 0
    docs = {(r.site, r.section): r.body for r in sections.section_docs(sections.section_merge(chunks), contacts).collect()}
    assert docs["z", "contact"] == "Emails: a@b.cd\nPhones: none"


def test_compression_follows_the_loop(spark):
    rnd = random.Random(5)
    rows = [(f"s{i}", k, "\n".join("x" * rnd.randrange(1, 4000) for _ in range(rnd.randrange(1, 30)))) for i in range(8) for k in V.SECTIONS if rnd.random() < 0.8]
    from sitelore.functions import text as T

    df = spark.createDataFrame(rows, "site string, section string, body string").withColumn("tokens", F.expr(T.tokens("body")))
    got = {(r.site, r.section): r["compress"] for r in document.compression_plan(df, 9000).collect()}
    n = lambda t: max(1, len(t) // 4) if t else 0

    def condense(text):
        used, out = 0, []
        for p in text.split("\n"):
            used += n(p)
            if used > V.CONDENSE_TOKENS:
                break
            out.append(p)
        return "\n".join(out) or text.split("\n")[0][: 4 * V.CONDENSE_TOKENS]

    want, by_site = {}, defaultdict(dict)
    for s, k, b in rows:
        by_site[s][k] = b
    for s, work in by_site.items():
        total = lambda: sum(n(t) for t in work.values())
        done = set()
        for k in reversed(V.SECTION_PRIORITY):
            if total() <= 9000:
                break
            if k in work and n(work[k]) >= V.CONDENSE_MIN_TOKENS:
                work[k] = condense(work[k])
                done.add(k)
        want |= {(s, k): k in done for k in work}
    assert got == want and any(want.values()) and not all(want.values())


def test_document_and_audit(spark):
    rows = [("a", "contact", "Emails: x@y.zz\nPhones: none"), ("a", "company_overview", "We make maps.\nSince 1990."), ("f", "faq", "q")]
    from sitelore.functions import text as T

    df = spark.createDataFrame(rows, "site string, section string, body string").withColumn("tokens", F.expr(T.tokens("body")))
    langs = spark.createDataFrame([("a", "en"), ("f", "fa")], "site string, lang string")
    bases = spark.createDataFrame([(s, f"https://{s}/") for s in "afn"], "site string, base_url string")
    docs = document.assemble_document(df, langs, bases).cache()
    by = {r.site: r for r in docs.collect()}
    assert by["a"].document == ("We make maps.\n\n## Table of Contents\n\n- Company Overview\n- Contact Information\n\n"
                                "## Company Overview\n\nWe make maps.\nSince 1990.\n\n## Contact Information\n\nEmails: x@y.zz\nPhones: none")
    assert by["f"].document == f"## {V.TOC_TITLE_FA}\n\n- {V.SECTIONS_FA['faq']}\n\n## {V.SECTIONS_FA['faq']}\n\nq"
    assert by["n"].document == "# Knowledge Base\n\nNo extractable customer knowledge was found on https://n/."
    contacts = spark.createDataFrame([("f", "", "021 555 0000")], "site string, emails string, phones string")
    audit = {r.site: r for r in document.completeness_audit(docs, contacts).collect()}
    assert (audit["a"].has_email, audit["a"].has_phone, audit["a"].has_contact, audit["a"].missing) == (True, False, True, "policies,faq,services")
    assert (audit["f"].has_phone, audit["f"].has_contact, audit["f"].has_faq, audit["f"].missing) == (True, True, True, "contact,policies,services")
    assert audit["n"].missing == "contact,policies,faq,services"


def test_target_tokens(spark):
    df = spark.createDataFrame([("5",), ("30000",), ("999999",), ("x",), (None,), ("-7",), ("99999999999",), ("9" * 40,), ("-" + "9" * 40,)], "x string")
    assert [r[0] for r in df.select(document.target_tokens(F.col("x"))).collect()] == [2000, 30000, 120000, 18000, 18000, 2000, 120000, 120000, 2000]


def test_site_language_is_the_vote_of_all_pages(spark):
    rows = [("a", 1, "the cat and the dog"), ("a", 2, "le chat et les chiens"), ("a", 3, "der Hund und die Katze"),
            ("a", 9, "le chien et les chats"), ("b", 1, "the cat"), ("b", 50, "le chat et les chiens"), ("d", 1, "the cat and"), ("c", 1, "این یک متن فارسی است و گچ پژ دارد")]
    df = spark.createDataFrame(rows, "site string, pos bigint, chunk string")
    assert {r.site: r.lang for r in content.site_language(df).collect()} == {"a": "fr", "b": "fr", "c": "fa", "d": "en"}
    assert {r.site: r.lang for r in content.site_language(df, 4).collect()} == {"a": "de", "b": "en", "c": "fa", "d": "en"}


def test_contacts_are_sorted_and_whole_unless_limited(spark):
    rows = [("s", f"u{i % 50:02d}@x.org") for i in range(400)] + [("s", "+1 202 555 0199"), ("t", "none")]
    df = spark.createDataFrame(rows, "site string, chunk string").repartition(6)
    got = {r.site: r for r in content.site_contacts(df).collect()}
    assert got["s"].emails.split(", ") == [f"u{i:02d}@x.org" for i in range(50)]
    assert content.site_contacts(df, limit=30).first().emails.split(", ") == [f"u{i:02d}@x.org" for i in range(30)]
    assert got["s"].phones == "+1 202 555 0199" and "t" not in got


# --- costs, companies, runs -----------------------------------------------------------------
def test_costs(spark):
    rows = [(1, "gpt-5-nano", 4200, 800), (1, None, 100, None), (1, "", 1, 1), (1, "gpt-4o-2024", 10, 20), (2, "zzz", 15420, 3280)]
    df = spark.createDataFrame(rows, "run_id int, model string, prompt_tokens bigint, completion_tokens bigint")
    got = {(r.run_id, r.model): (r.prompt_tokens, r.completion_tokens, r.cost_usd) for r in costs.cost_by_model(df).collect()}
    assert got == {(1, "gpt-5-nano"): (4301, 801, round(4301 / 1e6 * 0.05 + 801 / 1e6 * 0.4, 6)), (1, "gpt-4o-2024"): (10, 20, 0.000225), (2, "zzz"): (15420, 3280, 0.002083)}
    assert {r.run_id: r.total_cost_usd for r in costs.cost_estimate(df).collect()} == {1: f"{4301 / 1e6 * 0.05 + 801 / 1e6 * 0.4 + 0.000225:.6f}", 2: "0.002083"}
    assert {r.run_id: r.total_cost_usd for r in costs.cost_flat(df).collect()}[1] == f"{4311 / 1e6 * 0.05 + 821 / 1e6 * 0.4:.6f}"


def test_prospects(spark, tmp_path):
    texts = spark.createDataFrame([(1, "u1", "Maps maps ATLAS printing shop"), (1, "u2", "nothing"), (1, "u3", None), (1, "u4", " "),
                                   (2, "u1", "Maps maps ATLAS printing shop")], "request_id bigint, url string, text string")
    personas = spark.createDataFrame([(1, 1, "printing atlas"), (1, 2, "printing atlas cheap globes"), (2, 3, "a1 " + " ".join(f"atlas{c * 4}" for c in "abcdefghijklmnop"))],
                                     "request_id bigint, persona_id bigint, text string")
    got = {(r.request_id, r.url): tuple(r)[2:] for r in company.prospect_score(texts, personas).collect()}
    against = got.pop((2, "u1"))
    assert got == {(1, "u1"): (1, True, 100, "atlas, printing", ""), (1, "u2"): (1, False, 0, "", "atlas, printing")}
    assert against[:4] == (3, False, 0, "") and len(against[4].split(", ")) == 16  # its own request's persona, all reasons
    path = str(tmp_path / "p")
    sinks.write_csv(sinks.prospect_rows(company.prospect_report(texts, personas)), path, by=["request_id"])
    rows = {(r.request_id, r.website): r for r in sinks.read_csv(spark, path, V.PROSPECT_COLUMNS, "request_id bigint").collect()}
    assert len(rows) == 5
    assert (rows[1, "u1"].is_potential_customer, rows[1, "u1"].confidence_score, rows[1, "u1"].error) == ("true", "100", "")
    assert (rows[1, "u3"].status, rows[1, "u3"].confidence_score, rows[1, "u3"].error) == ("failed", "", V.EMPTY_PAGE_ERROR)


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", text', "two\nlines", None)], "x string, y string, z string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "c"), ["x", "y", "z"]).collect()] == [('a "quoted", text', "two\nlines", "")]


def test_markdown_per_site(spark, tmp_path):
    df = spark.createDataFrame([("a.example", "n", "# one\n\ntext"), ("b.example", "m", "two")], "site string, name string, content string")
    sinks.write_kb_markdown(df, str(tmp_path / "md"))
    files = list((tmp_path / "md" / "site=a.example" / "name=n").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == "# one\n\ntext\n"
    assert sorted(sinks.read_kb_markdown(spark, str(tmp_path / "md")).collect()) == sorted(df.collect())
    sinks.write_kb_markdown(df, str(tmp_path / "packed"), packed=True)
    assert sorted(spark.read.schema(df.schema).json(str(tmp_path / "packed")).collect()) == sorted(df.collect())


def test_progress_messages(ev):
    cases = {
        "Extracting from page 3/20: https://x.example:8080/a": "استخراج از صفحه 3/20: https://x.example:8080/a",
        "Extracting knowledge from pages...": V.PROGRESS_FA["Extracting knowledge from pages..."],
        "Extracting knowledge 3/9 pages...": V.PROGRESS_FA["Extracting knowledge"],
        "Writing section: FAQ...": V.PROGRESS_FA["Writing section"], "unknown": "unknown", None: None,
    }
    assert ev(runs.localise_progress("x"), list(cases)) == list(cases.values())


# --- elements -------------------------------------------------------------------------------
def locate(spark, html):
    df = spark.createDataFrame([(1, "s", html)], "page_id bigint, site string, html string")
    return {(r.category, r.xpath) for r in elements.page_xpaths(df).collect()}


def test_locators(spark):
    got = locate(spark, """<script><button id='menu'></script><BUTTON id="menu" class='btn'>Log-in: sign</BUTTON>
      <input type="submit" name='q1' placeholder="Find"><img alt="Profile Picture of X"><a href="/user/1" title="Home">12 posts</a>
      <a href="/x?a=1&amp;b=2">Don't hide</a><h1 class="a post-title">T</h1><form class="plain"></form><div role="button" id="auto1">x</div>""")
    assert {x for c, x in got if c == "buttons"} == {
        "//button[@id='menu']", "//button[contains(text(), 'Log-in: sign')]", "//button[text()='Log-in: sign']",
        "//div[@role='button']", "//input[@type='submit']", "//input[@placeholder='Find']"}
    assert {x for c, x in got if c == "links"} == {
        "//a[@title='Home']", "//a[contains(text(), 'Don\\'t hide')]", "//a[text()='Don\\'t hide']", "//a[@href='/x?a=1&b=2']"}
    assert ("images", "//img[contains(@alt, 'profile picture')]") in got
    assert ("headings", "//h1[contains(@class, 'post-title')]") in got
    assert not [x for c, x in got if c == "forms"]


def test_texts_of_nested_and_broken_markup(spark):
    html = """<button id="a"><span>Fol</span> <b>low</b></button><button id="b">Save<i>it<p>now</button>after
      <div role="button" id="c">x < y<div>in<br>ner</div> end</div></div><div role="button" id="d"/>out
      <a href="/l"><img alt="logo"><!-- no --><script>no</script>Home</a></i></p><BUTTON id="e">open <em>more"""
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    rows = elements.element_inventory(df).select("category", "selector", "element.*").collect()
    texts = {r.id: r.text for r in rows if r.category in ("buttons",)}
    assert texts == {"a": "Follow", "b": "Saveitnow", "c": "x < yinnerend", "d": "", "e": "openmore"}
    assert [r.text for r in rows if r.category == "links"] == ["Home"]
    # the test of a selector sees the text as it stands, with its blanks
    assert not [r for r in rows if r.selector == 'button:contains("Follow")']
    whole = df.withColumn("html", F.replace("html", F.lit("</span> <b>"), F.lit("</span><b>")))
    assert [r.id for r in elements.element_inventory(whole).filter("selector LIKE '%Follow%'").select("element.id").collect()] == ["a"]


def test_ends_of_tags_take_time_in_proportion_to_the_tags(spark):
    signs = ["div"] * 100_000 + ["/p"] * 100_000 + ["/div"] * 50_000
    got = elements.tag_ends.func(pd.Series([signs, [], None]))
    assert got[0][99_999] == 200_000 and got[0][50_000] == 249_999 and got[0][0] == len(signs) and got[1] == [] and got[2] is None


def test_inventory_takes_all_or_the_first_of_each_selector(spark):
    html = "".join(f'<a href="/{i}">x</a>' for i in range(9)) + '<p data-testid="LikeBox" aria-label="LIKE it"></p><a>no href</a><a href="">e</a>'
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    every = elements.element_inventory(df).select("category", "element.no").collect()
    assert [r.no for r in every if r.category == "links"] == [*range(1, 10), 12]
    rows = elements.element_inventory(df, 5).select("category", "selector", "element.no").collect()
    assert [r.no for r in rows if r.category == "links"] == [1, 2, 3, 4, 5]
    assert [(r.selector, r.no) for r in rows if r.category == "like_buttons"] == [('[aria-label*="like" i]', 10)]


def test_links(spark):
    html = """<!-- <a href="/no">x</a> --><a title="a>b" class=x href="/a?x=1&amp;y=2#f">1</a><A HREF='../b'>2</A><a href=c>3</a><a name="n">4</a><abbr href="/no">5</abbr>"""
    df = spark.createDataFrame([(1, "s", "https://s/d/e/f", html)], "page_id bigint, site string, url string, html string")
    assert [r.dst_url for r in links.extract_links(df).orderBy("link_no").collect()] == ["https://s/a?x=1&y=2", "https://s/d/b", "https://s/d/e/c"]
    base = df.withColumn("root", F.lit("https://s/"))
    assert [r.dst_url for r in links.extract_links(base, "root").orderBy("link_no").collect()][1:] == ["https://s/b", "https://s/c"]


# --- answers and prices -----------------------------------------------------------------------
def test_answers_of_all_kinds(spark):
    rows = [
        ("p1", "prospect", '{"is_potential_customer": true, "confidence_score": 88, "reasoning_for": "fits"}'),
        ("p2", "prospect", "no json"), ("p3", "prospect", None), ("p4", "prospect", '["a"]'),
        ("p5", "prospect", '```json\n{"confidence_score": "7", "is_potential_customer": "perhaps", "reasoning_against": null}\n```'),
        ("l1", "clusters", '{"buying_guides": {"urls": ["u1", null, "u2"]}, "company_information": {"urls": "u3"}, "other": {"urls": ["u4"]}, "priority_extraction_order": ["x"]}'),
        ("l2", "clusters", "{broken"), ("a1", "audit", 'Here: ```\n{"has_faq": true, "missing": ["faq"], "notes": "n"}\n```'),
        ("t1", "introduction", " Welcome. \n"), ("t2", "condensed", None), ("x", "unknown", "{}"),
    ]
    df = spark.createDataFrame(rows, "request_id string, kind string, content string")
    parsed = answers.parsed(df)
    got = {r.request_id: tuple(r)[1:] for r in answers.answer_objects(parsed, "prospect").collect()}
    assert got == {
        "p1": (True, True, 88, "fits", ""), "p2": (False, False, 0, "", ""), "p3": (False, False, 0, "", ""),
        "p4": (False, False, 0, "", ""), "p5": (True, False, 7, "", ""),
    }
    items = sorted(tuple(r) for r in answers.answer_items(parsed, "clusters").collect())
    assert items == [("l1", "buying_guides", 1, "u1"), ("l1", "buying_guides", 2, "u2"), ("l1", "priority_extraction_order", 1, "x")]
    assert [tuple(r) for r in answers.answer_objects(parsed, "audit").collect()] == [("a1", True, False, False, True, False, "n")]
    assert [tuple(r) for r in answers.answer_items(parsed, "audit").collect()] == [("a1", "missing", 1, "faq")]
    assert {tuple(r) for r in answers.answer_texts(df).collect()} == {("t1", "introduction", "Welcome."), ("t2", "condensed", "")}


def test_prices_come_from_a_table(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    prices = spark.createDataFrame(
        [("m", 1.0, 2.0, None), ("m-big", 5.0, 6.0, day(5)), ("m-big", 7.0, 8.0, day(9)), ("m-big-x", 9.0, 9.5, day(20)), ("", 99.0, 99.0, None), (None, 1.0, 1.0, None)],
        "name string, input double, output double, valid_from timestamp",
    )
    asked = [("m-big-x", 4), ("m-big-x", 5), ("m-big-x", 9), ("m-big-x", 21), ("m", 1), ("other", 9), ("", 9), (None, 9)]
    calls = spark.createDataFrame([(m, day(n), "kept") for m, n in asked], "model string, at timestamp, input string")
    priced = costs.price_of(calls, prices, default=(0.5, 0.6), at="at")
    got = {(r.model, r["at"].day): (r.input, r.output) for r in priced.collect()}
    assert got == {
        ("m-big-x", 4): (1.0, 2.0), ("m-big-x", 5): (5.0, 6.0), ("m-big-x", 9): (7.0, 8.0), ("m-big-x", 21): (9.0, 9.5), ("m", 1): (1.0, 2.0),
        ("other", 9): (0.5, 0.6), ("", 9): (0.5, 0.6), (None, 9): (0.5, 0.6),
    }
    assert "NestedLoop" not in priced._jdf.queryExecution().toString()
    first = prices.filter("valid_from IS NULL OR valid_from < '2024-01-06'")
    assert {r.model: r.input for r in costs.price_of(calls, first, (0.5, 0.6)).collect()}["m-big-x"] == 5.0


def test_totals_by_rollup(spark):
    from sitelore.operators import prefilter as P

    rows = [("s", i, u) for i, u in enumerate(["http://s/a", "http://s/a", "http://s/a.pdf", "mailto:x", "http://s/cart"])] + [("t", 0, "http://t/x.png")]
    df = spark.createDataFrame(rows, "site string, pos bigint, url string")
    by = {(r.site, r.reason): r.n for r in P.dropped_by_reason(df).collect()}
    got = {(r.site, r.reason, r.level): r.n for r in P.dropped_totals(df).collect()}
    want = {(*k, 0): n for k, n in by.items()}
    for site in ("s", "t"):
        want[site, None, 1] = sum(n for (s, _), n in by.items() if s == site)
    want[None, None, 3] = sum(by.values())
    assert got == want


def odd_pages(spark):
    """Pages with text, of blanks only, without HTML, and one that stands twice, and one without an address."""
    text = lambda n: f"<html><head><title>T{n}</title></head><body><p>Text number {n} of the site, long enough to be kept.</p></body></html>"
    rows = [
        (1, "s.example", "https://s.example/", text(1)), (2, "s.example", "https://s.example/about", text(2)),
        (2, "s.example", "https://s.example/about", text(2)), (3, "s.example", "https://s.example/faq", "<body> <p>  </p></body>"),
        (4, "s.example", "https://s.example/help", None), (5, "s.example", None, text(5)), (6, "t.example", "https://t.example/x", ""),
    ]
    return spark.createDataFrame(rows, "page_id bigint, site string, url string, html string")


def test_only_selected_pages_are_read_for_text(spark, tmp_path):
    odd_pages(spark).write.parquet(f"{tmp_path}/pages")
    kb = knowledge_base.build(spark.read.parquet(f"{tmp_path}/pages"))
    assert kb.bases.is_cached  # the start pages are not looked for again by each reader
    plan = kb.chunks._jdf.queryExecution().withCachedData().toString()
    lines = [line for line in plan.splitlines() if "html" in line]
    # a text is taken above the join: no filter takes it of every page, and no page is dealt out
    assert lines and not [line for line in lines if re.match(r"[\s:+*()\d-]*Filter\b", line) and "regexp" in line]
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning\(page_id", plan)
    got = sorted((r.page_id, r.url, r.title, r.chunk, r.section, r.tokens) for r in kb.chunks.collect())
    line = lambda n: f"Text number {n} of the site, long enough to be kept."
    assert got == [
        (1, "https://s.example/", "T1", line(1), "additional", 12),
        *[(2, "https://s.example/about", "T2", line(2), "company_overview", 12)] * 2,
        (5, None, "T5", line(5), "additional", 12),
    ]
    empty = kb.documents.filter("site = 't.example'").first()
    assert empty.sections_present == "" and empty.document.startswith(V.NO_CONTENT)
