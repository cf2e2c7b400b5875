"""Packing, sharding, preference pairs, pages and recordings."""

import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from millrace.llm import bestfit_packing, chroma_media, feistel_shards, lineblock_html, preference_chat

SF = "/root/testdata/sf0.001"


# --- packing


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [k for k, b in enumerate(bins) if b["room"] >= size and b["room"] > 0 and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        best = min(fits, key=lambda k: (bins[k]["room"], k), default=None)
        if best is None:
            bins.append({"room": capacity, "s": set(), "c": set()})
            best = len(bins) - 1
        bins[best]["room"] -= size
        bins[best]["s"].add(s)
        bins[best]["c"].add(c)
        out.append(best)
    return out


def test_packs_like_a_plain_search():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(0, 120)
        sizes = [rng.randint(1, 50) for _ in range(n)]
        sources, clusters = [rng.choice([-1, 0, 0, 0, 1, 2, 3]) for _ in range(n)], [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        assert bestfit_packing.pack_group(sizes, sources, clusters, 60)[0] == plain_best_fit(sizes, sources, clusters, 60)


def test_packing_is_whole_and_without_conflicts(spark):
    rng = random.Random(2)
    big = (1 << 60) + 1
    rows = [(big + i, rng.choice([0, 5, 30, 99, 100, 101, 250]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, 1, 2])) for i in range(400)] + [(None, 7, "a", None), (3, None, None, None), (3, None, None, None)]
    items = spark.createDataFrame(rows, "doc_id long, size int, source string, cluster long")
    got = bestfit_packing.packed(items, capacity=100, group_items=150).collect()
    by_doc, bins = {}, {}
    facts = {r[0]: r for r in rows}
    for r in got:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["n_tokens"]
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(by_doc[k] == (v[1] or 0) for k, v in facts.items()) and sum(r["doc_id"] == 3 for r in got) == 2
    for members in bins.values():
        assert sum(m["n_tokens"] for m in members) <= 100
        spans = sorted((m["bin_offset"], m["bin_offset"] + m["n_tokens"]) for m in members)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for column in (2, 3):
            values = [facts[m["doc_id"]][column] for m in members if facts[m["doc_id"]][column] is not None]
            assert len(values) == len(set(values))
    assert bestfit_packing.packed(items.limit(0)).collect() == []


def test_items_count_words(spark):
    docs = spark.createDataFrame([(1, " a  b\nc ", "s"), (2, None, "s"), (3, "", None), (4, "  ", None), (5, "\t\x0ba\f\r\nb \x85", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["cluster"] is None) for r in bestfit_packing.document_items(docs).collect()}
    assert got == {1: (3, False), 2: (0, True), 3: (0, True), 4: (0, False), 5: (3, False)}


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_query_packs_like_a_plain_search_over_each_group(spark, kind):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 5, 30, 60, 99, 130]), rng.choice(["hot", "hot", "a", None]), rng.choice([None, None, 1, 2])) for i in range(200)]
    rows += [rows[0]] * 150  # a repeated row
    items = spark.createDataFrame(rows, "doc_id int, size int, source string, cluster long").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = bestfit_packing.packed(items, capacity=100, group_items=100)
    assert got.schema["doc_id"].dataType == items.schema["doc_id"].dataType
    got = got.collect()
    facts, groups = {str(r[0]): r for r in rows}, {}
    for r in got:
        groups.setdefault(r["bin_id"] >> 32, []).append(r)
        assert r["doc_offset"] == 100 * r["part"]
    assert len(groups) == 4 and len(got) == sum(max(1, -(-r[1] // 100)) for r in rows)
    assert max(sum(str(r["doc_id"]) == "0" for r in g) for g in groups.values()) < 80
    for members in groups.values():
        key = lambda r: (-r["n_tokens"], str(r["doc_id"]), r["part"])
        members = sorted(members, key=lambda r: (*key(r), r["bin_id"]))
        code = lambda k: [{v: i for i, v in enumerate(dict.fromkeys(facts[str(r["doc_id"])][k] for r in members))}[facts[str(r["doc_id"])][k]] if facts[str(r["doc_id"])][k] is not None else -1 for r in members]  # noqa: B023, E731
        want = plain_best_fit([r["n_tokens"] for r in members], code(2), code(3), 100)
        assert sorted(zip(map(key, members), want)) == sorted(zip(map(key, members), (r["bin_id"] & 0xFFFFFFFF for r in members)))


def test_bins_as_sequences(spark):
    tokens = {1: list(range(10, 16)), 2: [20, 21], 3: [30], 4: []}
    items = spark.createDataFrame([(k, len(v), f"s{k}", None) for k, v in tokens.items()], "doc_id long, size int, source string, cluster long")
    bins = bestfit_packing.sequences(bestfit_packing.packed(items, capacity=4), spark.createDataFrame(list(tokens.items()), "doc_id long, token_ids array<int>")).collect()
    assert sorted(r["token_ids"] for r in bins) == [[10, 11, 12, 13], [14, 15, 20, 21], [30]]
    mixed = next(r for r in bins if r["token_ids"][0] == 14)
    assert mixed["segments"] == [1, 1, 2, 2] and mixed["loss_mask"] == [0, 1, 0, 1]
    assert [tuple(d) for d in mixed["documents"]] == [(1, 4, 0), (2, 0, 2)]


def test_near_copies_never_share_a_bin(spark, tmp_path):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[k:] + [f"e{k}"] * k) for k in range(5)]  # each is linked with the next
    rows = [(k, t, f"s{k}") for k, t in enumerate(texts)] + [(None, texts[2], "s8"), (9, "something else", "s9"), (10, " ", None), (11, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = bestfit_packing.packing_query(spark, str(tmp_path)).collect()
    bins = [r["bin_id"] for r in got if r["n_tokens"] > 2]
    assert len(got) == len(rows) and len(bins) == len(set(bins)) == 6


def test_classes_among_a_groups_texts_equal_brute_force():
    from test_duplicates import sets_of

    rng = random.Random(11)
    base = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(5)]
    texts = [None, "", " ", "one two", "one two"]
    for words in base:
        for _ in range(8):
            new = list(words)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = "x"
            texts.append(" ".join(new[rng.randrange(6) :]))
    rng.shuffle(texts)
    sets = sets_of(texts, 5)
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                old, new = parent[i], parent[j]
                parent = [new if x == old else x for x in parent]
    got = bestfit_packing.near_classes(texts)
    assert all((got[i] < 0) == (not sets[i]) for i in range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]]
    assert all((got[i] == got[j]) == (parent[i] == parent[j]) for i, j in pairs) and len(set(got)) < 40
    assert bestfit_packing.near_classes([]).tolist() == []


def test_repeated_rows_and_ids_are_dealt_to_all_groups(spark):
    rows = [(None, f"text {i} of many words", "s") for i in range(120)] + [(5, "the same row again", "t")] * 120 + [(6, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(4), "cluster": F.lit(None).cast("string")})
    got = bestfit_packing.packed(docs, group_items=20, text="text").collect()
    groups = [r["bin_id"] >> 32 for r in got]
    assert len(got) == len(rows) and len(set(groups)) > 8 and max(groups.count(g) for g in set(groups)) < 60
    assert bestfit_packing.packed(docs.limit(0), text="text").collect() == []


# --- sharding


def plain_place(number, rows, seed):
    a, b = feistel_shards.domain(rows)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    hashed = lambda x, key: signed(xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)))

    def network(x):
        left, right = divmod(x, b)
        for k in range(feistel_shards.ROUNDS):
            m = b if k % 2 else a
            left, right = right, (left + hashed(right, seed * 1_000_003 + k) % m) % m
        return left * b + right

    x = network(number)
    while x >= rows:
        x = network(x)
    return x


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 40, 41, 1000])
def test_permutation_equals_a_plain_one(spark, rows):
    got = [r["p"] for r in spark.range(rows).orderBy("id").select(feistel_shards.permuted(F.col("id"), rows, 20).alias("p")).collect()]
    assert sorted(got) == list(range(rows)) and got == [plain_place(i, rows, 20) for i in range(rows)]


def test_shards_of_the_documents(spark):
    rows = feistel_shards.shards_query(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows" and r["grown_shard"] is None
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(40)]
    assert all(slots == list(range(len(slots))) for slots in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert rows != sorted(rows, key=lambda r: r["doc_id"])


def test_query_equals_a_plain_one(spark, tmp_path):
    rows = [(i * 7, "text %d" % (i % 5)) for i in range(300)] + [(5, None), (None, "x"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    keys = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows]

    def hashed(key):
        h = 42
        for v in key:
            h = h if v is None else xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    order = sorted(keys, key=lambda k: (hashed(k), [(v is not None, v or 0) for v in k]))
    want = sorted(((*k, place % 40, place // 40) for n, k in enumerate(order) for place in [plain_place(n, len(rows), 20)]), key=str)
    got = [(r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in feistel_shards.shards_query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == want


def test_hot_first_keys_and_own_columns(spark, monkeypatch):
    monkeypatch.setattr(feistel_shards, "ROWS_A_BUCKET", 50)
    rows = spark.createDataFrame([(None if i % 3 else 1, i, f"b{i}", i) for i in range(600)], "k long, v long, _bucket string, _number long")
    out = feistel_shards.sharded(rows, ["k", "v"], 7)
    assert out.columns == ["k", "v", "_bucket", "_number", "shard", "slot"]
    assert all(r["_bucket"] == f"b{r['v']}" and r["_number"] == r["v"] for r in out.collect())
    assert feistel_shards.numbered(rows, ["k", "v"]).agg(F.countDistinct("row_number"), F.max("row_number")).first()[:] == (600, 599)


def test_long_walks_end(spark, monkeypatch):
    monkeypatch.setattr(feistel_shards, "FIRST_STEPS", 1)
    for rows in (5, 17, 101, 626):
        got = [r["p"] for r in spark.range(rows).orderBy("id").select(feistel_shards.permuted(F.col("id"), rows, 3).alias("p")).collect()]
        assert got == [plain_place(i, rows, 3) for i in range(rows)]


def test_row_numbers_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 700, i) for i in range(2500)] + [(None, 1), (None, 1)], "k long, shard long")
    one = {(r["k"], r["v"]): r["n"] for r in feistel_shards.numbered(rows.withColumnRenamed("shard", "v"), ["k", "v"], "n").where("k IS NOT NULL").collect()}
    two = feistel_shards.numbered(rows.withColumnRenamed("shard", "v").repartition(9), ["k", "v"], "n").collect()
    assert sorted(r["n"] for r in two) == list(range(2502))
    assert {(r["k"], r["v"]): r["n"] for r in two if r["k"] is not None} == one
    assert feistel_shards.sharded(rows.limit(0), ["k"], 4).collect() == []
    assert set(feistel_shards.sharded(rows, ["k"], 4).columns) == {"k", "shard", "slot"}


# --- preference pairs


def test_pairs_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(preference_chat.ORACLE_SQL)
    got = preference_chat.preference_query(spark, SF)
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_pairs_edges(spark):
    schema = "pair_id long, turn long, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi <|end|>", "z"), (1, 1, "assistant", "yes", "z"), (2, 0, "user", None, "z"), (3, 1, "assistant", "b", "z"), (3, 0, None, "a", "z"), (None, 0, "user", "x", "z"), (4, 0, "user", "q", "z")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi <|end|>", "z"), (1, 1, "assistant", "no", "z"), (1, 2, "user", "why", "z"), (2, 0, "user", "", "z"), (3, 0, "user", "other", "z"), (None, 0, "user", "x", "z")], schema)
    got = {r["pair_id"]: r for r in preference_chat.preference_pairs(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3]
    r = got[1]
    assert r["n_common"] == 1 and r["prompt"] == "<|turn|>user\nhi < |end|><|end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["yes<|end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["no<|end|>"] and "why" in r["rejected"]
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["n_common"] == 0 and got[3]["prompt"] == "" and got[3]["chosen"].startswith("<|turn|>\na")
    assert preference_chat.preference_pairs(chosen.limit(0), rejected).collect() == []


# --- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href='/'>x</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three<p>Short.<div class='ad-slot'>Buy</div><script>var t='</p>';</script></article><footer>&copy;</footer>", "T & U\nOne two three\nShort."),
        ("<article><header><h1>T</h1></header><p>w<b>or</b>d&nbsp;x</p><aside>no</aside><section id='comments'><p>Nice!</p></section><form><p>Mail</p></form></article>", "T\nword x"),
        ("<div id=menu><a href=1>home</a></div><div>" + "<p>" + "long text " * 12 + "</p><p>ok</p></div><div class='cookieNotice'>We use cookies</div>", ("long text " * 12).strip() + "\nok"),
        ("<p>tiny", "tiny"),
        ("<article><p>a < b and <3 c</p></article>", "a < b and <3 c"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("<!-- <p>no</p> --><main><ul><li>one<li>two</ul></main>", "one\ntwo"),
    ],
)
def test_main_text(page, text):
    assert lineblock_html.main_text(page) == text


def paragraphs(name):
    return [f"{name} {k} " + "long text " * 12 + "end." for k in range(4)]


def marked_up(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_text_outside_an_article_is_kept():
    body = paragraphs("body")
    teaser = "<article><h3><a href=1>Read this too</a></h3></article>"
    for page in (f"<div>{marked_up(body)}</div>{teaser}", f"{teaser}<div>{marked_up(body)}</div>"):
        got = lineblock_html.main_text(page).split("\n")
        assert [x for x in got if x != "Read this too"] == body
    # a long first paragraph before the article counts, short lines around it do not
    page = f"<div>Posted today</div><p>{body[0]}</p><article><h1>T</h1><p>ok</p>{marked_up(body[1:])}</article><div>All rights reserved</div>"
    assert lineblock_html.main_text(page) == "\n".join([body[0], "T", "ok", *body[1:]])


@pytest.mark.parametrize("attributes", ["class='social-science'", "id=comment-on-the-budget-vote", "class='network-sidebars share-price'"])
def test_words_of_a_subject_mark_nothing(attributes):
    body = paragraphs("body")
    assert lineblock_html.main_text(f"<article>{marked_up(body[:2])}<div {attributes}>{marked_up(body[2:])}</div></article>") == "\n".join(body)


def test_the_surge_decides_on_pages_without_an_article(monkeypatch):
    page = f"<div><p>{'a short notice ' * 4}</p></div>" + "<div>x</div>" * 5 + f"<div>{marked_up(paragraphs('body'))}</div>"
    kept = {}
    for surge in (20, 86, 200):
        monkeypatch.setattr(lineblock_html, "SURGE_CHARS", surge)
        kept[surge] = lineblock_html.main_text(page)
    assert "short notice" in kept[20] and "short notice" not in kept[86] and "body 3" in kept[86]


@pytest.mark.parametrize("attributes", ["class=comment", "class='depth-1 comment-item'", "id='relatedPosts'", "role=complementary", "hidden"])
def test_articles_marked_as_boilerplate(attributes):
    body, other = paragraphs("body"), paragraphs("reader")
    page = f"<article class='post category-social has-sidebar'>{marked_up(body)}</article><article {attributes}>{marked_up(other)}</article>"
    assert lineblock_html.main_text(page) == "\n".join(body)


def test_pages_operator(spark):
    rows = spark.createDataFrame([(1, "<article><p>x</p></article>", "old"), (2, None, "old"), (3, "<article>" + "<p>é1</p>" * 20_000, "old")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in lineblock_html.extract(rows).collect()}
    assert got[1] == "x" and got[2] == "" and got[3] == "\n".join(["é1"] * 20_000)
    assert lineblock_html.extract(rows.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "more"),
    [
        ('<div id="page" class="has-sidebar"><article>{}</article></div>', []),
        ('<div class="content-with-sidebar">{}</div>', []),
        ('<div class="sidebar-page"><div class=sidebar><p>no</p></div><article>{}</article></div>', []),
        ('<article><div class="entry-header"><h1>T</h1></div>{}</article>', ["T"]),
        ('<div class="page-header"><h1>T</h1></div><div>{}</div>', ["T"]),
        ('<article><h2 class="section-header">T</h2>{}</article>', ["T"]),
        ('<article><p class="side-by-side">T</p>{}</article>', ["T"]),
        ('<header><h1>Site</h1></header><main><h1>T</h1>{}</main>', ["T"]),
        ('<div class=widget>{}</div><footer><p>no</p></footer>', []),
    ],
)
def test_a_name_never_drops_the_text(page, more):
    body = paragraphs("body")
    assert lineblock_html.main_text(page.format(marked_up(body))) == "\n".join([*more, *body])


def plain_article(page):
    """What stands in the generated pages' article, by another way: cut it out, drop what is not shown, split at tags."""
    import html
    import re

    start = page.index("<article>") + len("<article>")
    end = page.find("</article>", start)
    body = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav|footer)\b.*?</\1>", "", page[start : end if end >= 0 else len(page)])
    body = re.sub(r'(?s)<(div|section|ul)[^>]*class="[^"]*"[^>]*>.*?</\1>', "", body)
    body = re.sub(r"<(?:br|/?[bi]|/?em|/?strong|/?a|/?span)\b[^>]*>", lambda m: " " if m[0].startswith("<br") else "", body)
    lines = (" ".join(html.unescape(x).split()) for x in re.split(r"<[a-zA-Z/][^>]*>", body))
    return "\n".join(x for x in lines if x)


def sample_pages():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


def test_pages_equal_a_plain_second_way():
    pages = [p for p in sample_pages() if "<article>" in p]
    assert len(pages) > 200
    assert [lineblock_html.main_text(p) for p in pages] == [plain_article(p) for p in pages]


def test_surge_and_window_decide_on_whole_pages(monkeypatch):
    pages = sample_pages()
    kept = [lineblock_html.main_text(p) for p in pages]
    for name, value in (("SURGE_CHARS", 400), ("SURGE_CHARS", 100_000), ("WINDOW_LINES", 1)):
        with monkeypatch.context() as m:
            m.setattr(lineblock_html, name, value)
            assert sum(lineblock_html.main_text(p) != k for p, k in zip(pages, kept, strict=True)) > 0.05 * len(pages)
    # the article's tag plays no part: as a plain element it has the same text
    as_div = [lineblock_html.main_text(p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in pages]
    assert sum(a == b for a, b in zip(as_div, kept, strict=True)) > 0.98 * len(pages)


# --- recordings


def test_filters_equal_direct_sums():
    rng = np.random.default_rng(3)
    samples = chroma_media.melody(rng.standard_normal(40) / 8)
    frames = chroma_media.chroma(samples)
    codes = chroma_media.audio_fingerprint(samples)
    assert len(codes) == len(frames) - chroma_media.SPAN + 1
    for t in (0, 7, len(codes) - 1):
        code = 0
        for kind, y, h, w in chroma_media.FILTERS:
            area = lambda x0, x1, y0, y1: frames[t + x0 : t + x1, y0:y1].sum()  # noqa: B023, E731
            half, mid, quarter = w // 2, h // 2, w // 4
            if kind == 0:
                a, b = area(0, half, y, y + h), area(half, w, y, y + h)
            elif kind == 1:
                a, b = area(0, w, y, y + mid), area(0, w, y + mid, y + h)
            elif kind == 2:
                a = area(0, half, y, y + mid) + area(half, w, y + mid, y + h)
                b = area(0, half, y + mid, y + h) + area(half, w, y, y + mid)
            else:
                a, b = area(quarter, w - quarter, y, y + h), area(0, quarter, y, y + h) + area(w - quarter, w, y, y + h)
            level = int(np.searchsorted([-0.35, 0.0, 0.35], np.log((0.1 + a) / (0.1 + b))))
            code = (code << 2) | (level ^ (level >> 1))
        assert code == codes[t]


def test_excerpts_are_found_where_they_begin(spark):
    got = chroma_media.media_query(spark, SF).collect()
    best = {}
    for r in got:
        if r["query_id"] not in best or r["bit_error"] < best[r["query_id"]]["bit_error"]:
            best[r["query_id"]] = r
    ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").collect()]
    right = [k for k in ids if k in best and best[k]["class_id"] == k and best[k]["offset_frames"] == 8 + k // 20 % 16]
    assert len(right) >= 0.9 * len(ids)


def test_recordings_edges(spark):
    v = [float(x) for x in np.sin(np.arange(64)) / 5]
    rows = spark.createDataFrame([(1, v), (3, v), (20, v), (4, None), (5, []), (None, v)], "vec_id long, embedding array<float>")
    media = chroma_media.recordings(rows)
    index, members = chroma_media.classes(chroma_media.fingerprints(media, "vec_id", "audio"))
    assert [(r["class_id"], r["n_copies"]) for r in index.collect()] == [(1, 3)] and members.count() == 3
    assert chroma_media.audio_fingerprint(np.zeros(100, "<i2")).tolist() == []
    assert len(set(chroma_media.audio_fingerprint(np.zeros(9000, "<i2")).tolist())) == 1


def test_equal_recordings_are_named(spark, tmp_path):
    rng = np.random.default_rng(8)
    v, w = ([float(x) for x in rng.standard_normal(64) / 8] for _ in range(2))
    rows = spark.createDataFrame([(1, v), (3, v), (20, v), (4, w), (5, None)], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = chroma_media.media_query(spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["class_id"], r["n_copies"]) for r in got if r["member_id"] is None] == [(20, 1, 3)]
    assert sorted((r["class_id"], r["member_id"]) for r in got if r["query_id"] is None) == [(1, 1), (1, 3), (1, 20)]


def plain_best(q, codes):
    step, best = chroma_media.KEY_STEP, None
    short = min(len(q), len(codes)) <= step
    for offset in range(1 - len(q), len(codes)):
        over = [(x, codes[i + offset]) for i, x in enumerate(q) if 0 <= i + offset < len(codes)]
        votes = sum(a == b for a, b in over) if short else sum(over[i][0] == over[i][1] and over[i + step][0] == over[i + step][1] for i in range(len(over) - step))
        error = sum((a ^ b).bit_count() for a, b in over) / (32 * len(over))
        if votes and error <= chroma_media.MOST_BIT_ERROR and (best is None or votes > best[1]):
            best = (offset, votes, error)
    return best


def test_held_notes_are_runs(spark):
    rows = spark.createDataFrame([(1, [5] * 300), (2, [1, 1, 2, 2, 2, 1]), (3, [])], "class_id long, codes array<long>")
    got = sorted((r["class_id"], r["at"], r["n"], r["code"]) for r in chroma_media._single_keys(rows, "class_id").collect())
    assert got == [(1, 0, 300, 5), (2, 0, 2, 1), (2, 2, 3, 2), (2, 5, 1, 1)]
    assert chroma_media._keys(rows, "class_id").where("class_id = 1").count() == 1
    asked = spark.createDataFrame([(9, [5] * 200 + [6])], "query_id long, codes array<long>")
    best = chroma_media.aligned(asked, rows.withColumn("n_copies", F.lit(1))).first()
    want = plain_best([5] * 200 + [6], [5] * 300)
    assert (best["offset_frames"], best["votes"], best["bit_error"]) == want


def test_alignment_equals_a_plain_search(spark):
    rng = random.Random(9)
    tune = [rng.getrandbits(32) for _ in range(40)]
    silent = [0] * 12
    # the silence collects the most votes at an offset where the rest differs
    index = [(1, tune), (2, tune[:1]), (3, tune[5:7]), (4, silent + tune + silent[:2]), (5, tune[:10] + silent + [x ^ 0xFFFFFFFF for x in tune[10:30]]), (6, tune[3:6])]
    asked = [(1, tune[8:30]), (2, tune[6:7]), (3, tune[4:7]), (4, tune[:3]), (5, silent[:8] + tune[:14]), (6, tune[10:34] + silent)]
    frames = [spark.createDataFrame(x, f"{name} long, codes array<long>") for x, name in ((asked, "query_id"), (index, "class_id"))]
    got = {(r["query_id"], r["class_id"]): (r["offset_frames"], r["votes"], r["bit_error"]) for r in chroma_media.aligned(frames[0], frames[1].withColumn("n_copies", F.lit(1))).collect()}
    want = {(a, b): best for a, q in asked for b, codes in index if (best := plain_best(q, codes))}
    assert got == want and any(a == 2 for a, _ in want) and any(b == 2 for _, b in want)
