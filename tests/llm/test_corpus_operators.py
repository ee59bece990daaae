"""Repeats, near-duplicates, the classifier, decontamination, pages and archives against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql.functions import input_file_name

from tidewatt.llm import html, quality, repeats, simhash, warc
from tidewatt.llm.components import connected_components
from tidewatt.llm.decontaminate import HammingBlocks, leaked_items, mark_leaks

from .corpus import SHARED, documents, empty, prose, texts


# Repeats


def plain_repeats(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    out = Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if starts[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 3, 1])
def test_repeats(spark, group):
    """Groups of any size are found by the same order of columns: those beyond the bound are split until the string has no open byte."""
    passage, edge = prose(70, 90)[:430], prose(71, 200)
    rows = texts() + [(60 + i, prose(300 + i, 50) + passage[: 395 + 5 * i] + prose(400 + i, 50)) for i in range(7)] + [(70, edge), (71, edge[:399]), (72, edge[-401:]), (73, "x" + edge[:400] + "é" + edge[100:500])]
    got = repeats.remove_repeats(documents(spark, rows), group=group).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows)
    if group == 1:
        assert repeats.remove_repeats(empty(spark)).count() == 0


def test_rows_of_a_frequent_string_do_not_meet(spark, monkeypatch):
    """What many documents share is dealt to several tasks in every step that stages it, and removed all the same."""
    passage = prose(70, 90)[:430]
    rows = [(i, prose(300 + i, 30) + passage + prose(500 + i, 30)) for i in range(60)]
    files, real = {}, repeats.stage

    def stage(df, name, **options):
        out = real(df, name, **options)
        if name == "samples":
            for r in out.select("gram", input_file_name().alias("file")).collect():
                files.setdefault(r.gram, []).append(r.file)
        return out

    monkeypatch.setattr(repeats, "stage", stage)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeats.remove_repeats(documents(spark, rows), group=16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows)
    often = [f for f in files.values() if len(f) >= 60]
    assert often and all(len(set(f)) > 1 for f in often)


@pytest.mark.parametrize("group", [2, 50])
def test_rows_among_keys(spark, group):
    """Keys of few and of many rows pass alike, each row once; only those of over ``group`` rows are large."""
    rows = spark.createDataFrame([(key, i, 0, i) for key in range(5) for i in range(20 * key + 1)], "key long, t long, n long, place long")
    keys = spark.createDataFrame([(0, 1), (1, 21), (4, 81)], "key long, many long")
    got = Counter((r.key, r.t, r.large) for r in repeats._among(rows, keys, ["key"], group).collect())
    assert got == Counter((key, i, many > group) for key, many in ((0, 1), (1, 21), (4, 81)) for i in range(many))


def test_columns_inserted_one_by_one():
    rng = np.random.default_rng(4)
    contexts = rng.integers(0, 2, (200, 24)).astype(np.uint8)
    groups = rng.integers(0, 5, 200)
    got = repeats.repeated_windows(groups, contexts, 8)
    for column in range(17):
        seen = Counter((g, c[column : column + 8].tobytes()) for g, c in zip(groups, contexts, strict=True))
        assert (got[:, column] == [seen[g, c[column : column + 8].tobytes()] > 1 for g, c in zip(groups, contexts, strict=True)]).all()


def test_samples_agree_in_equal_strings(monkeypatch):
    text = np.frombuffer((prose(8, 900) + "ab" * 700).encode(), np.uint8)
    whole = repeats.sample_places(repeats.Rolling(text), text.size)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    assert (repeats.sample_places(repeats.Rolling(text), text.size) == whole).all()
    for start in range(0, text.size - 400, 97):
        own = repeats.sample_places(repeats.Rolling(text[start : start + 400]), 400)
        assert own.size == 1 and own[0] + start in whole


# Near-duplicates


def plain_components(prints, radius):
    ids = list(prints)
    label = {i: i for i in ids}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}


def plain_print(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(spark, monkeypatch):
    rows = [(i, t) for i, t in texts() if i is not None]
    monkeypatch.setattr(simhash, "SPLIT", 5)  # groups are split into chunks
    monkeypatch.setattr(simhash, "GROUP", 7)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = {i: plain_print(t) for i, t in rows}
    want = plain_components(prints, 4)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{prints[i]:016x}", want[i]) for i, _ in rows)
    assert len(simhash.near_duplicates(documents(spark)).collect()) == len(texts())
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 4])
def test_large_node_pairs_descend(spark, monkeypatch, radius):
    """Dense fingerprints in one bucket: groups of over two descend to the leaves."""
    monkeypatch.setattr(simhash, "SPLIT", 2)
    rng = np.random.default_rng(radius)
    base = [0x0123456789ABCDEF, 0xF123456789ABCDEF, 0x0123456789AB0000]
    values = {int(rng.choice(base)) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 7)).tolist())) for _ in range(90)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v, v) for v in signed], "node long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(nodes, radius)).collect()}
    label = {}
    for v, c in ((v % (1 << 64), got.get(v, v)) for v in signed):
        label.setdefault(c, set()).add(v)
    want = {}
    for v, c in plain_components({v: v for v in sorted(values)}, radius).items():
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, label.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_trie_join(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = {int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, radius + 2)).tolist())) for b in base for _ in range(6)}
    values = np.array(sorted(values), np.uint64)
    labels = simhash.Labels(values.size)
    for start in [0, *simhash.block_ends(radius)[:-1]]:
        turned = (values << np.uint64(start)) | (values >> np.uint64(64 - start)) if start else values
        order = np.argsort(turned)
        found = simhash.trie_links(turned[order], np.array([[0, values.size, 0, values.size, 0]]), radius, simhash.depth_budgets(radius))
        labels.join(order, order[found])
    want = plain_components(dict(enumerate(map(int, values))), radius)
    assert labels.of.tolist() == [want[i] for i in range(values.size)]


def test_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 6)
    base = prose(50, 300).split()
    rows = [(i, " ".join([*base[: 10 * i], "edit", *base[10 * i + 1 :]])) for i in range(20)] + [(100 + i, prose(500 + i, 300)) for i in range(20)] + [(200, ""), (201, " \n")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), words=5, radius=20, similarity=0.8).collect()}
    assert {got[i] for i in range(20)} == {0} and all(got[100 + i] == 100 + i for i in range(20)) and got[201] == 200


def test_similarity_is_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 2, raising=False)
    rows = []
    for i in range(40):  # 296 shared shingles and 37 or 38 of each: 0.8 and 0.7957
        for side in range(2):
            rows.append((10 * i + side, prose(3000 + i, 300) + " " + prose(4000 + 2 * i + side, 37 + i % 2)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), words=5, radius=20, similarity=0.8).collect()}
    assert [got[10 * i + 1] == 10 * i for i in range(40)] == [i % 2 == 0 for i in range(40)]


def test_repeated_shingles_do_not_count(spark):
    rows = []
    for i in range(30):  # the same set of shingles, those of one line repeated
        line = prose(6000 + i, 10)
        rows += [(10 * i + side, prose(5000 + i, 120) + f"\n{line}" * times) for side, times in enumerate((2, 40))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows), words=5, radius=20, similarity=0.8).collect()}
    assert all(got[10 * i + 1] == 10 * i for i in range(30))


def test_short_sets_are_found():
    rng = np.random.default_rng(12)
    sets = rng.integers(0, 2**64, (30_000, 5), dtype=np.uint64)
    apart = [k for k, s in enumerate(sets) if not set(simhash.least_shingles(s, 0.8)) & set(simhash.least_shingles(s[:4], 0.8))]
    for size in (10, 36, 39, 40, 45, 48):
        for s in rng.integers(0, 2**64, (200, size), dtype=np.uint64):
            apart += [s for other in (s[: -(-size * 4 // 5)],) if not set(simhash.least_shingles(s, 0.8)) & set(simhash.least_shingles(other, 0.8))]
    assert not apart
    bits = [(simhash.fingerprint(s) ^ simhash.fingerprint(s[:4])).bit_count() for s in sets]
    assert max(bits) <= simhash.alike_radius(0.8) and sum(b > 20 for b in bits) > 50


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(-7, 1000 + i) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    graph = defaultdict(set)
    for a, b in edges:
        if a != b:
            graph[a].add(b), graph[b].add(a)
    for node in graph:
        reach, todo = {node}, [node]
        while todo:
            for other in graph[todo.pop()] - reach:
                reach.add(other), todo.append(other)
        assert got[node] == min(reach)
    assert set(got) == set(graph)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# Classifier


def test_quality(spark):
    good = [(i, prose(600 + i, 60)) for i in range(150)]
    bad = [(200 + i, " ".join(w + "$$$" for w in prose(800 + i, 60).split()) if i % 2 else " ".join(w for w in prose(800 + i, 12).split() for _ in range(9))) for i in range(100)]
    docs = documents(spark, good + bad + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + bad] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).withColumn("held", quality.held_out("doc_id"))
    assert set(scored.columns) - {"held"} == set(docs.columns)
    rows = scored.collect()
    held = [r for r in rows if r.held and r.doc_id < 900]
    assert len(held) > 30 and np.mean([(r.score >= 0.3) == (r.doc_id < 200) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 252
    assert len({r.score for r in rows if r.doc_id >= 900}) == 1
    none = quality.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(empty(spark), none).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs = documents(spark, [(i, prose(i, 20)) for i in range(40)])
    ids = [r.doc_id for r in docs.filter(quality.held_out("doc_id")).collect()]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    assert 3 < len(ids) < 20 and {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {0.5}


# Decontamination


def test_leaks(spark):
    item, other, short = prose(90, 40), prose(91, 25), "three little words"
    words = item.split()
    edited = [*words[:20], "changed", *words[21:]]
    rows = texts() + [(500, prose(92, 90) + " " + item.upper() + ". " + prose(93, 9)), (501, prose(94, 30) + " " + " ".join(words[:20]) + " " + prose(95, 30)), (502, " ".join([*words[:-1], "end"])), (503, other + "\n" + item), (504, " ".join(edited)), (505, "here are three little, words!"), (506, item), (506, item)]
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, short), (4, None), (5, ""), (None, item), (1, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in leaked_items(documents(spark, rows), benchmark).collect())
    assert got == Counter({(500, 1): 1, (502, 1): 1, (503, 1): 1, (503, 2): 1, (505, 3): 1, (506, 1): 2})
    marked = mark_leaks(documents(spark, rows), benchmark)
    assert marked.count() == len(rows) and mark_leaks(empty(spark), benchmark).count() == 0
    assert leaked_items(documents(spark), benchmark.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("tidewatt.llm.decontaminate.BLOCK_CHARS", 400)
    items = [(i, prose(700 + i, 20)) for i in range(12)]
    docs = documents(spark, [(i, prose(40 + i, 30) + " " + t) for i, t in items])
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


def test_hamming_blocks_find_all():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**64, 200, dtype=np.uint64)
    index = HammingBlocks(prints, 24)
    for probe in rng.integers(0, 2**64, 20, dtype=np.uint64):
        assert index.near(probe).tolist() == np.flatnonzero(np.bitwise_count(prints ^ probe) <= 24).tolist()


# Pages


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>Head &amp; line</h1><p><b>One  two<br><p>Three&nbsp;four &lt;x&gt;</p><script>var t="</p>";</script><!-- <p>no</p> --><ul><li>Item one.<li>Item two.</ul><p>Last.</article>
<section class="comments"><p>I think so too.</p></section><form><label>Mail</label></form><aside><p>More to read.</p></aside><footer>&copy; Someone</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", PAGE), (1, "u", PAGE), (4, "x", "<div><p"), (5, "y", PAGE.replace("One", "word " * 30_000))], "page_id long, url string, html string")
    rows = html.extract_main_text(pages).collect()
    want = "Head & line\nOne two\nThree four <x>\nItem one.\nItem two.\nLast."
    assert Counter(r.text for r in rows if r.page_id in (1, None)) == {want: 3} and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (2, 3)} == {""} and next(r.n_chars for r in rows if r.page_id == 5) > 150_000
    assert html.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>t</title><body>", "<html><head><meta content='a <p> b'><title>t</title><link href=x>", "<head><title>t<body>", "<head><script>'<p>'</script><style>p{}</style><!-- <p> --><title>t</title></head>", "<head><noscript><p>no</p></noscript>",
        "<svg width='1'/>", "<svg>", "<svg-icon></svg-icon>", "<head-line></head-line>", "<template>", "<noscript>", "<select>", "<iframe src='x'>", "<svg><svg></svg><text>no</text></svg>", "<iframe srcdoc='a<br/>b'></iframe>", "<select><option>no</select>",
    ],
)
def test_text_after_elements_without_an_end_tag(start):
    texts = [b.text for b in html.leaf_blocks(start + "<article><p>Main text.</p><svg><text>no</text></svg><p>Last.</p></article>")]
    assert texts[-2:] == ["Main text.", "Last."] and not any("no" in t.split() for t in texts)
    assert html.leaf_blocks("<head><title>t</title>Main text.")[0].text == "Main text."


def test_field_on_pages_it_has_not_seen():
    field, right, total = html.default_field(), 0, 0
    for page in html.labelled_pages(150, seed=1234):
        blocks = html.leaf_blocks(page)
        gold = [int(html.MAIN in b.text) for b in blocks]
        for block in blocks:
            block.text = block.text.replace(html.MAIN, "").strip() or "-"
        found = field.viterbi(html.features(blocks))
        right, total = right + sum(a == b for a, b in zip(found, gold, strict=True)), total + len(gold)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(8)
    field = html.Field({"a": 0, "b": 1, "c": 2}, rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    chain = [["a"], ["b", "c"], ["c"], ["a", "b"], ["b"], ["a", "c"]]

    def value(labels):
        return sum(field.weights[field.index[n], y] for names, y in zip(chain, labels, strict=True) for n in names) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:], strict=False))

    paths = [[n >> i & 1 for i in range(6)] for n in range(64)]
    assert field.viterbi(chain) == max(paths, key=value)


# Archives


def test_archive(spark, monkeypatch):
    for name, value in {"FILE_BYTES": 700, "BLOCK_CAPTURES": 4, "INDEX_CAPTURES": 9, "AT_ONCE": 900, "CHUNK": 500}.items():
        monkeypatch.setattr(warc, name, value)
    rows = [(i, f"https://www.site{i % 5}.example.com/{i}?q=1", f"<p>page {i % 7}</p>" * 9) for i in range(30)] + [(40, None, None), (41, "x", ""), (41, "x", ""), (42, "http://[bad", "<p>ü</p>\r\n\r\nx"), (None, "n", "<p>page 1</p>" * 9), (43, "a\r\nb", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect())
    last = defaultdict(list)
    for i, _, text in rows:
        last[text or ""].append(i)
    want = Counter()
    for i, _, text in rows:
        owner = max(x for x in last[text or ""] if x is not None)
        want[i, len((text or "").encode()), warc.digest_of((text or "").encode()), "response" if i == owner else "revisit", None if i == owner else owner] += 1
    assert got == want
    index = warc.build_index(warc.write_archive(pages))
    assert len(index) > 2 and warc.url_key("HTTP://WWW.Example.com:80/a?b#c") == "com,example,www)/a?b"
    asked = spark.createDataFrame([(rows[3][1],), (rows[17][1],), (rows[17][1],), ("http://nowhere.example/",)], "url string")
    hits = warc.read_captures(warc.look_up(index, asked), with_payload=True).collect()
    assert {r.page_id for r in hits} == {"3", "17"} and len(hits) == 2 and all(r.record_type == "revisit" or bytes(r.payload).decode() == rows[int(r.page_id)][2] for r in hits)
    assert warc.look_up(index, asked.limit(0)).count() == 0 and warc.look_up([], asked).count() == 0
    assert {r.record_type for r in warc.archive_and_read(pages, revisit_bytes=10_000).collect()} == {"response"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    named = warc.archive_and_read(pages.selectExpr("concat('p/ü ', page_id) AS page_id", "url", "html")).filter("page_id = 'p/ü 41'").collect()
    assert len(named) == 2 and all(r.refers_to is None and r.record_type == "response" for r in named)


def test_any_reader_opens_the_archive(spark, tmp_path):
    """The files of an archive, by gzip and the format's own rules: header lines, a length, two line ends."""
    import gzip

    rows = [(i, f"http://a.example/{i}", f"<p>{'é' * i}</p>") for i in range(12)] + [(90, "http://b.example/", "<p></p>")]
    captures = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), folder=str(tmp_path)).collect()
    found = {}
    for file in tmp_path.glob("*.warc.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            content, data = data[: int(fields["Content-Length"])], data[int(fields["Content-Length"]) :]
            assert version == "WARC/1.1" and data.startswith(b"\r\n\r\n") and fields["WARC-Record-ID"].startswith("<urn:uuid:")
            data = data[4:]
            if fields["WARC-Type"] != "warcinfo":
                found[int(fields["X-Page-ID"])] = (fields["WARC-Target-URI"], fields["WARC-Type"], content.partition(b"\r\n\r\n")[2].decode())
    assert found == {i: (url, "revisit" if i == 0 else "response", "" if i == 0 else text) for i, url, text in rows} and len(captures) == 13
    for c in captures:  # each range is a gzip member of its own
        with open(c.file, "rb") as file:
            file.seek(c.start)
            assert warc.parse(file.read(c.size)).headers["X-Page-ID"] == c.id


# Plain versions


def test_word_vectors_equal_a_plain_count(spark):
    """Context sums word by word over all documents, and the mean of the vectors of a text."""
    rows = [(i, t) for i, t in texts() if len(t or "") < 5000]
    got = quality.context_sums(documents(spark, rows), "text")
    index = quality.index_vectors().astype(np.int64)
    want = np.zeros((quality.BUCKETS + 1, quality.WIDTH), np.int64)
    for _, text in rows:
        ids = quality.word_numbers(text or "").tolist()
        for i, word in enumerate(ids):
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    want[word] += index[ids[j]]
    assert (got == want).all()
    vectors = np.random.default_rng(2).normal(size=(quality.BUCKETS + 1, quality.WIDTH)).astype(np.float32)
    found = [t or "" for _, t in rows]
    means = [np.mean([vectors[i].astype(float) for i in quality.word_numbers(t)], axis=0) if quality.word_numbers(t).size else np.zeros(quality.WIDTH) for t in found]
    assert np.allclose(quality.pooled(found, vectors), means, atol=1e-5)


def test_leaks_equal_a_plain_scan(spark):
    """Every window of every document against every item, by exact similarity."""
    import random

    from tidewatt.llm.decontaminate import SIMILARITY, WORDS, similarity, words_of

    rng = random.Random(11)
    items = [(i, prose(500 + i, rng.choice([3, 8, 20, 45, 90]))) for i in range(24)] + [(30, "one two three"), (31, "a a a a a a a a a a"), (32, None), (33, "...")]
    docs = []
    for i in range(70):
        words = prose(900 + i, rng.randint(0, 60)).split()
        for _ in range(rng.randint(1, 3)):
            copy = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if copy:
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([["other"], [], [copy[at], "more"]])
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    want = {}
    for i, text in docs:
        words = words_of(text)
        for item, gold in items:
            gold = words_of(gold or "")
            best = max((similarity(words[k : k + len(gold)], gold, min(WORDS, len(gold))) for k in range(len(words) - len(gold) + 1)), default=0) if gold else 0
            if best >= SIMILARITY:
                want[i, item] = round(best, 9)
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want and len(want) > 40


def test_viterbi_finds_the_best_labels():
    from itertools import product

    field, rng = html.default_field(), np.random.default_rng(5)
    names = sorted(field.index)
    for _ in range(40):
        chain = [rng.choice(names, rng.integers(1, 6), replace=False).tolist() + ["unknown"] for _ in range(rng.integers(1, 9))]
        emit = [sum(field.weights[field.index[n]] for n in some if n in field.index) for some in chain]
        score = lambda labels: sum(e[y] for e, y in zip(emit, labels, strict=True)) + sum(field.steps[a][b] for a, b in zip(labels, labels[1:], strict=False))  # noqa: B023, E731
        assert score(field.viterbi(chain)) == pytest.approx(max(map(score, product((0, 1), repeat=len(chain)))))


def test_blocks_equal_a_plain_parser(spark):
    """The blocks of given pages, by Python's own HTML parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.text, self.skipped = [], "", 0

        def flush(self):
            if self.text.split():
                self.blocks.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("head", "script", "style", "svg", "template", "noscript", "select", "iframe"):
                self.skipped += 1
                self.text += " "
            elif tag in html.BLOCKS:
                self.flush()
            elif tag in ("br", "hr"):
                self.text += " "

        def handle_endtag(self, tag):
            if tag in ("head", "script", "style", "svg", "template", "noscript", "select", "iframe"):
                self.skipped -= 1
            elif tag in html.BLOCKS:
                self.flush()

        def handle_data(self, data):
            if not self.skipped:
                self.text += data

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        plain.flush()
        assert [b.text for b in html.leaf_blocks(page or "")] == plain.blocks


def test_pages_without_end_tags_keep_their_text():
    blocks = lambda page: [b.text for b in html.leaf_blocks(page)]
    assert blocks("<html><head><title>T</title><body><p>Hello world text.</p>") == ["Hello world text."]
    for tag in ("select", "noscript", "svg", "iframe", "template"):
        assert blocks(f"<p>one<{tag}><p>two</p>") == ["one", "two"] and blocks(f"<p>one<{tag}>no</{tag}><p>two</p>") == ["one", "two"]
    assert blocks("<head>Hello <p>there") == ["Hello", "there"] and blocks("3 < 5 and <b>6</b> > 2") == ["3 < 5 and 6 > 2"]
    assert blocks("<p title='a>b' data-x=\"<i>\">t</p>") == ["t"] and blocks("&#" + "1" * 5000 + ";&#0065;") == ["\ufffdA"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<a " * 300_000, '<a "' * 200_000, '<a ">" ' * 100_000, "<div>a" * 50_000, "<li><tr><dt><ul>" + "<div>" * 20_000 + "<li><tr><dt>" * 20_000, "<!-- " * 100_000, "<svg>" * 100_000, "<" * 300_000, "<head>" * 50_000, '<p class="' * 50_000):
        html.features(html.leaf_blocks(page))
    assert time.perf_counter() - began < 40
