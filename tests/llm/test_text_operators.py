"""Packing, secrets, media and lines against plain versions of what they promise."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewatt.llm import media, secrets
from tidewatt.llm.lines import Shard, dedup_lines
from tidewatt.llm.packing import Encoder, Schedule, pack
from tidewatt.llm.perfect_hash import PerfectHash
from tidewatt.llm.queries import tokenizer_path
from tidewatt.llm.secrets import scan_secrets

from .corpus import documents, empty, prose, texts


# Packing


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    some = [t for _, t in texts() if t is not None] + ["İstanbul ΣΑΣ don't I'LL ''s !!'s 12345 ²½", "tab\tnew space\x85next \x1f sep", "é é", "a" * 3000, "ȺbȾ c Ƀd", "a\x0bb\x0cc\xa0d", " ", "\n\n"]
    for got, text in zip(ours.encode(pa.array(some)), some, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


def test_added_tokens_in_a_text():
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    some = ["hello <|endoftext|> world", "a <|STARTOFTEXT|> b<|startoftext|>c", "no <| endoftext |> here", "<|endoftext|", "endoftext", "Hello world"]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in ours.encode(pa.array(some))]
    assert got == [plain.encode(text, add_special_tokens=False).ids for text in some]
    assert got[0] == [3306, 49407, 1002] and 49406 in got[1]


@pytest.mark.parametrize("totals, weights", [([5000, 300, 10, 1], [5000, 300, 10, 1]), ([9000, 9000, 500], [1, 3, 2]), ([100, 0, 40], [0, 5, 0]), ([2048], [1]), ([7], [7])])
def test_schedule_is_a_round_robin_with_carried_deficits(totals, weights):
    schedule = Schedule(totals, weights, 128)
    states = [schedule.before(k) for k in range(schedule.windows + 1)]
    assert states[0] == [0] * len(totals) and states[-1] == totals
    for a, b in zip(states, states[1:], strict=False):
        assert all(x <= y for x, y in zip(a, b, strict=True)) and sum(b) - sum(a) <= 128
    assert all(sum(s) == 128 * k for k, s in enumerate(states[:-1]))
    if weights == totals:
        for k, state in enumerate(states[:-1]):
            assert all(abs(x - 128 * k * t / sum(totals)) < len(totals) + 1 for x, t in zip(state, totals, strict=True))


def test_schedule_equals_serving_the_queues_in_turn():
    """Each queue in turn gets its part of what the window has left, and what rounding leaves it is carried to the next window."""
    totals, weights, window = [70_000, 31_000, 9_000, 500, 12], [70_000, 31_000, 9_000, 500, 12], 256
    schedule = Schedule(totals, weights, window)
    served, credit = [0] * len(totals), [0] * len(totals)
    for k in range(1, schedule.starts[1] + 1):
        left, total = window, sum(weights)
        for i in range(len(totals) - 1, 0, -1):
            credit[i] += left * (total - weights[i])
            rest, credit[i] = divmod(credit[i], total)
            served[i] += left - rest
            left, total = rest, total - weights[i]
        served[0] += left
        assert schedule.before(k) == served
    assert schedule.starts[1] > 400


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr("tidewatt.llm.packing.QUEUES", 3)
    rows = documents(spark, [(i, prose(i, 200 if i % 2 else 20)) for i in range(40)]).selectExpr("doc_id", "text", "IF(doc_id % 2 = 1, 'large', concat('small', doc_id)) AS source")
    found = pack(rows, tokenizer_path(), window=256).collect()
    assert {r.doc_id for r in found} == set(range(40)) and {r.source for r in found} == {"large", *(f"small{i}" for i in range(0, 40, 2))}
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in w) == 256 for k, w in held.items() if k < max(held))


def test_words_are_known_for_a_bounded_time(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr("tidewatt.llm.packing.CACHED_BYTES", 2000)
    plain, ours = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    for seed in range(30):
        text = prose(seed % 20, 60)
        assert np.frombuffer(ours.encode(pa.array([text]))[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert ours.held < 30_000


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    rows = pack(docs, tokenizer_path(), window=256).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for _, text in texts():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[len(ids), zlib.crc32(ids.tobytes())] += 1
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(windows) == list(range(len(windows))) and sum(sum(x for _, x in w) < 256 for w in windows.values()) <= 1
    assert sum(r.length for r in rows) == sum(n * c for (n, _), c in want.items())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts() if i is not None}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows if r.doc_id is not None)
    assert pack(empty(spark), tokenizer_path()).count() == 0
    shares = Counter()
    for r in pack(docs, tokenizer_path(), targets={"src0": 1, "src1": 1}, window=256).filter("sequence_id < 10").collect():
        shares[r.source] += r.length
    assert set(shares) == {"src0", "src1"} and abs(shares["src0"] - shares["src1"]) <= 2


# Secrets


def test_secrets(spark):
    key = "AKIA" + "B" * 16
    cases = {
        1: ("password=7602ad27cf5550de1c and x", (1, 0, 1)),
        2: (f"{key} alone", (0, 1, 0)),
        3: ("TOKEN : 'abc' API_KEY=\"0123456789ab\"", (1, 0, 0)),
        4: ("ſecret=abcdefghijklmnop", (0, 0, 0)),
        5: ("AKIA123 short password=short host=db.example.com user=joe", (0, 0, 0)),
        6: (f"user=joe\n{key}\nkJ8sLq2Zx0Vb7NmQ4Wt1Yp\nhttps://db.example.com/x", (0, 1, 0)),
        7: (f"{key}\n\nkJ8sLq2Zx0Vb7NmQ4Wt1Yp far away", (0, 1, 0)),
        8: ("see https://example.com/page and kJ8sLq2Zx0Vb7NmQ4Wt1Yp", (0, 0, 0)),
        9: ("login=joe password=hunter22 host=db.example.com", (0, 0, 0)),
        10: (None, (0, 0, 0)),
    }
    found = {r.doc_id: r for r in scan_secrets(documents(spark, [(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: (r.n_assign, r.n_access, r.n_hex) for i, r in found.items()} == {i: c for i, (_, c) in cases.items()}
    assert found[1].base_sha256 == hashlib.sha256(b"assign:0:27,hex:9:27").hexdigest() and found[1].spans == "assign:0:27,hex:9:27"
    assert {s.split(":")[0] for s in found[6].spans.split(",")} == {"access", "identifier", "secret", "endpoint"}
    assert found[7].spans == "access:0:20" and found[5].spans == "" and found[8].spans == ""
    assert {s.split(":")[0] for s in found[9].spans.split(",")} == {"identifier", "secret", "endpoint"}
    assert scan_secrets(documents(spark)).count() == len(texts()) and scan_secrets(empty(spark)).count() == 0


def test_base_spans_equal_a_plain_scan():
    from tidewatt.llm.secrets import base_spans

    for text in ["x token=AKIA" + "0a" * 12 + " AKIAAKIA" + "Z9" * 8 + " deadbeefdeadbeef0 secret = = aaaaaaaaaaaaaaaa", "api-key=aaaaaaaaaaaaaaaa api_key=aaaaaaaaaaa apikey: \"bbbbbbbbbbbb\""]:
        found = base_spans(text)
        assert found["hex"] == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert found["access"] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        assert found["assign"] == [m.span() for m in re.finditer(r"([pP]assword|[pP]asswd|[sS]ecret|[tT]oken|[aA]pi_?[kK]ey)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]


def plain_links(text):
    """Parts by scanning each paragraph alone, with all pairs of spans compared."""
    assign = r"(?:[pP]assword|[pP]asswd|[sS]ecret|[tT]oken|[aA]pi_?[kK]ey)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    user = r"(?:access_?key|client_?id|account|login|user(?:_?name)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._+-]{3,}"
    apart = lambda s, others: all(b <= s[0] or s[1] <= a for a, b in others)
    out, at = Counter(), 0
    for scope in re.split(r"(\n[\x20\t\r]*\n)", text):
        find = lambda pattern: [m for m in re.finditer(pattern, scope)]  # noqa: B023, E731
        strong = [m.span() for m in find(assign) if len(m[1]) >= 12] + [m.span() for m in find("[0-9a-f]{16,}")]
        access = [m.span() for m in find("AKIA[A-Z0-9]{14,}")]
        ends = [m.span() for m in find(r"[a-z][a-z0-9+.-]*://[^\s\"'<>]+")]
        ends += [m.span() for m in find(r"(?:host|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?") if apart(m.span(), ends)]
        ids = [m.span() for m in find(user) if apart(m.span(), strong + access)]
        weak = [m.span() for m in find(assign) if 6 <= len(m[1]) < 12 and apart(m.span(), strong + access)]
        weak += [m.span() for m in find("[A-Za-z0-9+/_-]{20,}={0,2}") if apart(m.span(), strong + access + ids + ends + weak) and secrets.random_looking(m[0])]
        for kind, spans, good in (
            ("secret", weak, access or (ids and ends)),
            ("identifier", ids, strong or (weak and ends)),
            ("endpoint", ends, (access and (strong or weak)) or (strong and ids) or (ids and weak)),
        ):
            out.update((kind, at + a, at + b) for a, b in spans if good)
        at += len(scope)
    return out


def test_links_equal_a_plain_scan():
    import random

    rng = random.Random(7)
    bits = ["user=joe", "login: eva.m", "AKIA" + "B7" * 8, "kJ8sLq2Zx0Vb7NmQ4Wt1Yp", "password=hunter22", "secret=" + "x1" * 9, "https://db.example.com/x", "host=db.example.com:5432", "0123456789abcdef77", "plain words here", "server : 10.0.0.1", "9+git+ssh://h/p", "\n\n", "\n \n", "\n", "x" * 400]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice([" ", "\n", ", "]) for _ in range(rng.randint(1, 14)))
        found = secrets.linked_spans(text, secrets.base_spans(text))
        assert Counter((k, a, b) for k, spans in found.items() for a, b in spans) == plain_links(text), text


def test_hostile_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 400_000, "a." * 200_000, "token=" * 80_000, "user=abc " * 40_000 + "x=" * 1000, "Ab1" * 150_000 + " http://x", "AKIA" * 100_000, "\n " * 200_000, "password: abcdefg\n\n" * 20_000):
        base = secrets.base_spans(text)
        secrets.linked_spans(text, base)
    assert time.perf_counter() - began < 15


# Media


def test_image_forms_round_trip():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    for data in (media.encode_pgm(image, "a note"), media.encode_bmp(image), b"P2\n# c\n7 9\n255\n" + " ".join(map(str, image.ravel())).encode()):
        assert (media.decode(data)[0] == image).all()
    colour = rng.integers(0, 256, (4, 5, 3), dtype=np.uint8)
    assert (media.decode(b"P6 5 4 255\n" + colour.tobytes())[0] == colour).all()
    bits = rng.integers(0, 2, (3, 11))
    packed = np.packbits(bits, axis=1).tobytes()
    assert (media.decode(b"P4\n11 3\n" + packed)[0] == (1 - bits) * 255).all() and (media.decode(b"P1 11 3 " + "".join(map(str, bits.ravel())).encode())[0] == (1 - bits) * 255).all()
    assert (media.decode(b"P5 2 1 65535\n\x01\x02\x03\x04")[0] == [[258, 772]]).all()
    with pytest.raises(ValueError):
        media.decode(b"P5 4 4 255\nxx")


def test_area_resize_equals_the_mean_of_areas():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 18)).astype(float)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    big = np.kron(image, np.ones((5, 7)))
    assert np.allclose(media.area_resize(image, 5, 7), media.area_resize(big, 5, 7))
    assert np.allclose(media.area_resize(np.full((3, 64), 9.0), 8, 9), 9)


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media(spark, form):
    rows = media.media_columns(documents(spark), form=form).collect()
    assert len(rows) == len(texts())
    want = Counter()
    for i, text in texts():
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert all(bytes(r.tile)[:6] == b"\x93NUMPY" and len(r.feature) == 16 for r in rows)
    assert media.media_columns(empty(spark), form=form).count() == 0


# Lines


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64))
    table = PerfectHash.build(keys)
    assert (np.sort(table.numbers(keys)) == np.arange(keys.size)).all()
    shard = Shard.build(keys.view(np.int64), keys[::-1].copy().view(np.int64), np.ones(keys.size, np.int64), np.arange(keys.size))
    shard = Shard.from_row({k: v[0] for k, v in shard.to_row().items()})
    known, owner = shard.owner(keys.view(np.int64), keys[::-1].copy().view(np.int64))
    assert known.all() and (owner == np.arange(keys.size)).all()
    foreign = np.random.default_rng(4).integers(0, 2**63, keys.size)  # fingerprints that no key has
    assert not np.isin(foreign, keys.view(np.int64)).any()
    assert not shard.owner(keys.view(np.int64) + 1, foreign)[0].any() and not shard.owner(keys.view(np.int64), foreign)[0].any()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def plain_dedup(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    big = float("inf")
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(big if i is None else i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)]) == (big if i is None else i)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(spark, monkeypatch):
    rows = texts() + [(50, "  A LINE TO REPEAT\nshort\nown line of fifty\nA line to repeat\t"), (51, "a line to repeat\nshort"), (51, "another row of it\nA Line To Repeat"), (52, "ÀÉ upper accents\nàé upper accents"), (53, "àé UPPER accents")]
    docs = documents(spark, rows)
    got = dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"} and {r.rest for r in got.collect()} == {"r"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == plain_dedup(rows)
    monkeypatch.setattr("tidewatt.llm.lines.HOT_KEYS", 1)  # all keys lie in shards
    monkeypatch.setattr("tidewatt.llm.lines.SHARD_PROBES", 3)  # and their probes are salted
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs).collect()) == plain_dedup(rows)
    assert dedup_lines(empty(spark)).count() == 0
    named = dedup_lines(docs.selectExpr("concat('doc', lpad(doc_id, 4, '0')) AS doc_id", "text", "rest"))
    assert Counter((r.doc_id and int(r.doc_id[3:]), r.n_lines, r.n_dropped, r.text) for r in named.collect()) == plain_dedup(rows)
