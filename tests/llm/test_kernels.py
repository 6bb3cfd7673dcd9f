"""The operators' inner parts against plain versions."""

import base64
import collections
import gzip
import hashlib
import io
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tributary.llm import bpe, decontaminate, jaccard, language_id, pii, shingles, substring_dedup, toxicity, warc, webp


def ppm(texts, text, order=3):
    """Code length by dictionaries and sets, one byte at a time."""
    seen = {}
    for t in texts:
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                seen.setdefault(t[i - k : i], collections.Counter())[t[i]] += 1
    bits = 0.0
    for i, b in enumerate(text):
        out = set()
        for k in range(min(i, order), -1, -1):
            after = seen.get(text[i - k : i])
            if not after:
                continue
            total = sum(n for x, n in after.items() if x not in out)
            kinds = sum(x not in out for x in after)
            if b in after:
                bits += math.log2((total + kinds) / after[b])
                break
            if kinds:
                bits += math.log2((total + kinds) / kinds)
            out = set(after)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_ppm_code_lengths():
    samples = {"a": [b"the cat sat on the mat", b"then the hat"], "b": [b"der hund und die katze", "über".encode()]}
    trees = language_id.fit(samples)
    for text in (b"the dog", b"\xff\x00the", b"x", "grün und über".encode(), b"the cat sat on the mat"):
        assert np.allclose(trees.score([text, b"zz"])[0], [ppm(samples[x], text) for x in ("a", "b")], rtol=1e-5)
    langs, scores = language_id.predict(trees, [None, "", "12 34!", "the cat", "die katze"])
    assert langs == ["und", "und", "und", "a", "b"] and scores[:3] == [0, 0, 0] and all(0 <= s <= 1 for s in scores)
    assert language_id.predict(language_id.fit({}), ["abc"]) == (["und"], [0.0])


def test_bpe_is_exact():
    import public_tokenizers as public
    import tiktoken

    path = bpe.vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.encoder(path)
    assert own.plain  # the fast pattern stands for the tokenizer's
    rng = random.Random(5)
    texts = ["", "a" * 3000, "ab" * 2000, " \n\t  x", "it's we'll I'd", "日本語 🎉 ½²", "\x1c\x85\xa0", "<|endoftext|>", "naïve café"]
    texts += ["".join(rng.choice("aeiouth ing\n\t  éüñ日本語🎉0123<>|&'s\x0b") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    assert own.encode(None) == b""
    tiny = bpe.BytePairEncoder({bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}, r"\S+")
    for _ in range(500):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode()
        assert tiny.encode_piece(piece) == ([tiny.ranks[piece]] if piece in tiny.ranks else tiny.merge(piece))


def plain_webp(data):
    """A reader of one lossless image that takes single bits and looks codes up in dictionaries."""
    body, place = data[20 : 20 + int.from_bytes(data[16:20], "little")], [0]

    def bits(n):
        out = 0
        for i in range(n):
            out |= (body[place[0] >> 3] >> (place[0] & 7) & 1) << i
            place[0] += 1
        return out

    def table(lengths):
        used = sorted((n, i) for i, n in enumerate(lengths) if n)
        if len(used) < 2:
            return used[0][1] if used else 0
        out, code, size = {}, 0, 0
        for n, i in used:
            code <<= n - size
            size = n
            out[n, code] = i
            code += 1
        return out

    def symbol(code):
        if isinstance(code, int):
            return code
        n, value = 0, 0
        while (n, value) not in code:
            n, value = n + 1, value << 1 | bits(1)
        return code[n, value]

    def read_code(size):
        lengths = [0] * size
        if bits(1):
            two = bits(1)
            lengths[bits(8 if bits(1) else 1)] = 1
            if two:
                lengths[bits(8)] = 1
            return table(lengths)
        own = [0] * 19
        for i in range(bits(4) + 4):
            own[[17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][i]] = bits(3)
        own, left = table(own), bits(2 + 2 * bits(3)) + 2 if bits(1) else size
        i, last = 0, 8
        while i < size and left:
            left -= 1
            c = symbol(own)
            if c < 16:
                lengths[i], last, i = c, c or last, i + 1
            else:
                n = {16: lambda: bits(2) + 3, 17: lambda: bits(3) + 3, 18: lambda: bits(7) + 11}[c]()
                for k in range(n):
                    lengths[i + k] = last if c == 16 else 0
                i += n
        return table(lengths)

    def value(prefix):
        return prefix + 1 if prefix < 4 else (2 + prefix % 2 << (prefix - 2) // 2) + bits((prefix - 2) // 2) + 1

    def image(w, h, main):
        cache_bits = bits(4) if bits(1) else 0
        assert not (main and bits(1))
        codes = [read_code(n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
        cache, out = {}, []
        while len(out) < w * h:
            g = symbol(codes[0])
            if g < 256:
                r, b, a = symbol(codes[1]), symbol(codes[2]), symbol(codes[3])
                new = [a << 24 | r << 16 | g << 8 | b]
            elif g < 280:
                n = value(g - 256)
                d = value(symbol(codes[4]))
                d = d - 120 if d > 120 else max(1, webp.DISTANCE_MAP[d - 1][0] + webp.DISTANCE_MAP[d - 1][1] * w)
                new = [None] * n
                for k in range(n):
                    new[k] = out[len(out) + k - d] if k < d else new[k - d]
            else:
                new = [cache.get(g - 280, 0)]
            out += new
            for v in new:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> 32 - cache_bits] = v
        return out

    four = lambda v: [v >> 24 & 255, v >> 16 & 255, v >> 8 & 255, v & 255]
    one = lambda p: (p[0] & 255) << 24 | (p[1] & 255) << 16 | (p[2] & 255) << 8 | p[3] & 255
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    assert bits(8) == 0x2F
    w, h = bits(14) + 1, bits(14) + 1
    bits(1), bits(3)
    steps, now = [], w
    while bits(1):
        kind = bits(2)
        if kind < 2:
            size = bits(3) + 2
            steps.append((kind, now, size, image(-(-now >> size), -(-h >> size), False)))
        elif kind == 2:
            steps.append((kind, now, 0, None))
        else:
            n = bits(8) + 1
            colours = [four(v) for v in image(n, 1, False)]
            for i in range(1, n):
                colours[i] = [(x + y) & 255 for x, y in zip(colours[i], colours[i - 1], strict=True)]
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, now, shift, colours))
            now = -(-now >> shift)
    out = [four(v) for v in image(now, h, True)]
    for kind, wide, size, extra in reversed(steps):
        if kind == 3:
            rows = [out[y * (-(-wide >> size)) :][: -(-wide >> size)] for y in range(h)]
            depth = 8 >> size
            index = [[row[x >> size][2] >> depth * (x % (1 << size)) & ((1 << depth) - 1) for x in range(wide)] for row in rows]
            out = [(extra + [[0] * 4] * 256)[i] for row in index for i in row]
            continue
        blocks = -(-wide >> size)
        for i in range(wide * h):
            y, x = divmod(i, wide)
            a, r, g, b = out[i]
            if kind == 2:
                out[i] = [a, (r + g) & 255, g, (b + g) & 255]
            elif kind == 1:
                _, rb, gb, gr = four(extra[(y >> size) * blocks + (x >> size)])
                r = r + (signed(gr) * signed(g) >> 5) & 255
                out[i] = [a, r, g, b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(r) >> 5) & 255]
            else:
                if not i:
                    guess = [255, 0, 0, 0]
                elif not y or not x:
                    guess = out[i - 1] if not y else out[i - wide]
                else:
                    left, top, right, corner = out[i - 1], out[i - wide], out[i - wide + 1], out[i - wide - 1]
                    mode = extra[(y >> size) * blocks + (x >> size)] >> 8 & 15
                    mid = lambda p, q: [(u + v) // 2 for u, v in zip(p, q, strict=True)]
                    near = lambda p, q: sum(abs(u - v) for u, v in zip(p, q, strict=True))
                    clip = lambda v: max(0, min(255, v))
                    guess = {
                        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mid(mid(left, right), top), 6: lambda: mid(left, corner), 7: lambda: mid(left, top),
                        8: lambda: mid(corner, top), 9: lambda: mid(top, right), 10: lambda: mid(mid(left, corner), mid(top, right)), 11: lambda: left if near(top, corner) < near(left, corner) else top,
                        12: lambda: [clip(u + v - c) for u, v, c in zip(left, top, corner, strict=True)],
                        13: lambda: [clip(m + int((m - c) / 2)) for m, c in zip(mid(left, top), corner, strict=True)],
                    }[mode]()
                out[i] = [(u + v) & 255 for u, v in zip(out[i], guess, strict=True)]
    flat = [one(p) for p in out]
    return [flat[y * w : (y + 1) * w] for y in range(h)]


def test_webp_round_trips():
    rng = np.random.default_rng(3)
    for k in range(12):
        h, w = rng.integers(1, 30, 2)
        few = rng.integers(0, 1 << 32, int(rng.integers(1, 40)), dtype=np.uint64).astype(np.uint32)
        pixels = rng.choice(few, (h, w))
        for steps in ((), (webp.PREDICTOR,), (webp.CROSS_COLOR, webp.SUBTRACT_GREEN), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS_COLOR, webp.SUBTRACT_GREEN)):
            for cache, back in ((0, False), (5, True)):
                modes = rng.integers(0, 14, (-(-h >> 3), -(-w >> 3))) if k % 2 else None
                table = rng.integers(0, 1 << 32, (-(-h >> 3), -(-w >> 3)), dtype=np.uint64).astype(np.uint32) if k % 2 else None
                data = webp.encode(pixels, steps, cache_bits=cache, back_references=back, modes=modes, multipliers=table)
                assert (webp.decode(data) == pixels).all() and plain_webp(data) == pixels.tolist(), (k, steps, cache, back)
    assert len(webp.DISTANCE_MAP) == 120


def test_webp_groups_of_codes():
    """An image whose codes are chosen by an entropy image: two groups, one for each block of columns."""
    out = webp._Writer()
    webp._head(out, 8, 4)
    out.put(0, 1), out.put(0, 1), out.put(1, 1), out.put(0, 3)
    webp._write_image(out, np.array([[0, 1 << 8]], np.uint32), main=False)
    for green in (7, 9):
        for value, size in ((green, 280), (1, 256), (2, 256), (255, 256)):
            webp._write_code(out, [int(i == value) for i in range(size)])
        webp._write_code(out, [0] * 40)
    pixels = webp.decode(webp._riff(out.bytes() + b"\0"))
    assert (pixels[:, :4] == 0xFF010702).all() and (pixels[:, 4:] == 0xFF010902).all()


def test_webp_payloads():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(("the", "of", "größe", "and", "word", "nuit", "12")) for _ in range(n)).encode()
    texts = [b"", b"a", "größer\n".encode() * 700, bytes(range(256)) * 3, b"x" * (webp.UNIT * webp.TILE_ROWS + 1), prose(300), rng.randbytes(3000), prose(9000), b"ab" * 90 + prose(40) + b"ab" * 400]
    payloads = [webp.padded(t) for t in texts]
    media = webp.store(payloads)
    assert webp.load(media) == payloads and webp.store([payloads[2]]) == [media[2]] and webp.store(payloads[::-1]) == media[::-1]
    assert webp.load([media[5], media[4] + media[5]]) == [payloads[5], payloads[4] + payloads[5]]
    for i in (0, 1, 2, 3, 5, 6, 8):
        assert b"".join(bytes(v >> s & 255 for s in (16, 8, 0)) for row in plain_webp(media[i]) for v in row) == payloads[i]
    assert len(media[7]) < 0.5 * len(payloads[7]) and len(media[2]) < 300
    assert [len(p) % 192 for p in payloads] == [0] * 9 and len(payloads[0]) == 192
    small = webp.decode(media[1])
    assert webp._split(small)[..., 1:].astype(np.uint8).tobytes() == payloads[1]
    with pytest.raises(ValueError):
        webp.decode(media[2][:60])
    with pytest.raises(ValueError):
        webp.decode(b"no image at all, just text")


def test_warc_records():
    body = "WARC/1.1\r\n\r\nüber".encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = lambda kind, n: f"WARC/1.1\r\nWARC-Type: {kind}\r\nX-Page-Id: 5\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {n}\r\n\r\n".encode()
    archive = head("response", len(http + body)) + http + body + b"\r\n\r\n" + head("revisit", len(http)) + http + b"\r\n\r\n"
    read = lambda data, want=lambda r: True, **o: list(warc.parse(io.BufferedReader(io.BytesIO(data)), want, o.get("payload", True), o.get("verify", True), "x"))
    rows = read(archive)
    assert [(r["record_type"], r["payload"], r["payload_bytes"], r["page_id"]) for r in rows] == [("response", body, len(body), 5), ("revisit", None, len(body), 5)]
    assert [r["record_type"] for r in read(archive, lambda r: r["record_type"] == "revisit")] == ["revisit"]
    assert read(archive, payload=False, verify=False)[0]["payload"] is None
    assert len(list(warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(archive)))), lambda r: True, True, True, "x"))) == 2
    for broken in (archive[:-60], archive.replace(body, body[::-1], 1), b"junk" + archive):
        with pytest.raises(ValueError):
            read(broken)


def test_shingles_and_intersections():
    texts = ["The cat, sat on THE mat today.", "the cat sat on the mat today", None, "", "one two", "Über straße ist ein wort hier"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [3, 3, 0, 0, 1, 2]
    assert (sets[0] == sets[1]).all()
    rng = np.random.default_rng(1)
    some = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (5, 30, 30, 1)]
    both = jaccard._intersections(some)
    assert all(both[i, j] == len(np.intersect1d(some[i], some[j])) for i in range(4) for j in range(4) if i != j)


def test_least_matches():
    """The bound is where the posterior mass above the threshold passes the tolerance."""
    for n, m in jaccard.least_matches(0.8, 1e-4).items():
        x = np.linspace(0, 1, 200_001)
        mass = lambda k: (x[160_000:] ** k * (1 - x[160_000:]) ** (n - k)).sum() / (x**k * (1 - x) ** (n - k)).sum()  # noqa: B023, E731
        assert mass(m) >= 1e-4 * 0.98 and (m == 0 or mass(m - 1) < 1e-4 * 1.02)


def test_masks_meet_every_substitution():
    """Whatever fifth of 13 to 20 words is substituted, one of the masks fits on words that agree."""
    masks = [[i for i, c in enumerate(m) if c == "1"] + [len(m)] for m in decontaminate.MASKS]
    for n in range(13, 21):
        for out in itertools.combinations(range(n), n // 5):
            same = [i not in out for i in range(n)]
            assert any(all(same[a + i] for i in m[:-1]) for m in masks for a in range(n - m[-1] + 1)), out


def test_masks_of_short_items():
    share = Fraction(4, 5)
    for n in range(1, 13):
        (mask,) = decontaminate.masks_for(n, 13, share)
        for out in itertools.combinations(range(n), n // 5):
            assert any(not set(range(a, a + len(mask))) & set(out) for a in range(n - len(mask) + 1))


def test_longest_runs():
    rng = np.random.default_rng(6)
    for _ in range(300):
        item = rng.integers(0, 6 if rng.random() < 0.3 else 10**6, rng.integers(1, 40)).astype(np.uint64)
        doc = rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64)
        n = min(len(item), len(doc))
        doc[:n] = np.where(rng.random(n) < 0.85, item[:n], doc[:n])
        pairs = [([x], [y]) for x in range(len(doc)) for y in range(len(item)) if doc[x] == item[y]]
        got = decontaminate.longest_runs(doc, [item], [pairs], 13, Fraction(4, 5), most=50)
        need, runs = min(13, len(item)), []
        for z in range(-len(item), len(doc)):
            same = [doc[z + j] == item[j] for j in range(len(item)) if 0 <= z + j < len(doc)]
            runs += [b - a for a in range(len(same)) for b in range(a + need, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
        assert len(got) == bool(runs) and all(r[1] in runs and 5 * r[2] >= 4 * r[1] and r[3] + r[1] <= len(doc) for r in got)
        assert all(r[1] >= max(runs) - max(runs) // 5 for r in got)  # substituted words at its ends are left out


def test_longest_runs_of_one_word():
    """An item and a document of one repeated word: every place of one meets every place of the other."""
    item, doc = np.ones(500, np.uint64), np.ones(20_000, np.uint64)
    places = [(list(range(20_000)), list(range(500)))]
    assert decontaminate.longest_runs(doc, [item], [places], 13, Fraction(4, 5)) == [(0, 500, 500, 0)]


def test_sieve_lets_all_seeds_through():
    h = np.random.default_rng(1).integers(0, 1 << 62, 5000, dtype=np.uint64)
    sieve = decontaminate.Sieve(16)
    for plane in range(8):
        sieve.table[decontaminate._slots(h[:2500], plane, 16)] |= np.uint8(1 << plane)
    passed = set(sieve.passes(h).tolist())
    assert passed >= set(range(2500)) and len(passed) < 2600


def test_feistel():
    net = pii.Feistel(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        image = [net.permute(i, n, "t") for i in range(n)]
        assert sorted(image) == list(range(n)) and [net.permute(v, n, "t", True) for v in image] == list(range(n))
    assert [net.permute(i, 1000, "t") for i in range(9)] != [pii.Feistel(b"other").permute(i, 1000, "t") for i in range(9)]


def test_pseudonyms():
    own = pii.Pseudonymizer(b"k")
    text = "4111 1111 1111 1111, 4111-1111-1111-1112; DE89 3704 0044 0532 0130 00 123-45-6789 666-45-6789 +1 (243) 555-5526 10.0.0.1 999.1.1.1 a.b+c@x.org 2024-02-29 29.02.2024 2023-02-29"
    out, found = own.text(text)
    assert [k for k, *_ in found] == ["card", "iban", "ssn", "phone", "ip", "email", "date", "date"]
    assert "4111-1111-1111-1112" in out and "666-45-6789" in out and "999.1.1.1" in out and "2023-02-29" in out
    assert pii.restore(out, b"k") == text and pii.restore(out, b"other") != text
    new = {k: v for k, _, _, v in found}
    digits = re.sub(r"\D", "", new["card"])
    assert pii.luhn_digit(digits[:-1]) == digits[-1] and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", new["card"])
    assert pii._iban_check("DE", new["iban"].replace(" ", "")[4:]) == new["iban"][2:4]
    iso, dotted = (v for k, _, _, v in found if k == "date")
    assert iso.split("-") == dotted.split(".")[::-1]
    assert own.text(None) == (None, []) and own.text("") == ("", [])
    assert own.text("x 10.0.0.1 y")[1][0][3] == new["ip"]


def test_pseudonyms_beside_other_numbers():
    own = pii.Pseudonymizer(b"k")
    card, iban = "4845168114407329", "ES91 2100 0418 4502 0005 1332"
    alone = {v: own.text(v)[1][0][3] for v in (card, "4111 1111 1111 1111", iban)}
    for text in (f"{card} 12/27", f"{card} 123", *(f"{card} {n:02d}" for n in range(100)), "4111 1111 1111 1111 123", "1234 4111 1111 1111 1111", f"{iban} BANK", f"{iban} 1234", f"{iban} IS"):
        value = next(v for v in alone if v in text)
        out, found = own.text(text)
        assert out == text.replace(value, alone[value]) and len(found) == 1
        assert pii.restore(out, b"k", found) == text
    assert own.text("DE00 4111 1111 1111 1111")[0] == f"DE00 {alone['4111 1111 1111 1111']}"
    row = "0 1 2 3 4 5 6 7 8 9 " * 40
    assert len(own.text(row)[1]) <= 1


def test_toxicity_learns_subwords():
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda bad: " ".join(rng.choice(plain) for _ in range(30)) + (" idiot moron" if bad else "")
    data = [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit([t for t, _ in data], [y for _, y in data])
    bad, good, misspelt, empty, none = model.score([text(True), text(False), text(False) + " idiott morons", "", None])
    assert bad > 0.5 > good and misspelt > 0.3 and empty == none
    assert max(toxicity.fit(["a"], [0]).score(["a", ""])) < 1e-300
    assert toxicity.features(["", None, "..."])[0].size == 0


def test_column_sort(tmp_path):
    """Marks equal those of a plain comparison, with contexts that end early on both sides."""
    rng = random.Random(4)
    for _ in range(30):
        length, before = 6, 4
        base = [bytes(rng.choice(b"ab") for _ in range(before + length)) for _ in range(4)]
        rows, left = [], []
        for _ in range(12):
            b = bytearray(rng.choice(base))
            b[rng.randrange(len(b))] = rng.choice(b"ab")
            a, z = rng.randint(0, 3), rng.randint(length + 1, before + length)
            rows.append(bytes(b[a:z])), left.append(a)
        got = substring_dedup.column_sort(rows, np.array(left), before, substring_dedup.Scratch(f"file:{tmp_path}/s"), length)
        at = lambda i, c: rows[i][c - left[i] : c - left[i] + length] if c >= left[i] and c - left[i] + length <= len(rows[i]) else None  # noqa: B023, E731
        want = [[at(i, c) is not None and any(at(j, c) == at(i, c) for j in range(12) if j != i) for c in range(before + 1)] for i in range(12)]
        assert got.tolist() == want
    assert not list((tmp_path / "s").iterdir())


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abcdef ") for _ in range(400))
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(n)) + passage + b"tail" * k for n, k in ((0, 0), (137, 50), (61, 9))]
    found = []
    for t in texts:
        count, h, p, *_ = substring_dedup.anchors([t])
        at = t.index(passage)
        inside = {(int(x), int(y) - at) for x, y in zip(h, p, strict=True)}
        for s in range(len(passage) - substring_dedup.LENGTH + 1):
            assert any(s <= off <= s + substring_dedup.LENGTH - substring_dedup.ANCHOR for _, off in inside)
        found.append({x for x in inside if 112 <= x[1] <= 400 - 200})
    assert found[0] == found[1] == found[2] and found[0]


def test_toxicity_pieces_of_long_texts():
    """A text that is cut scores as one that is not, and equal texts score alike whatever is beside them."""
    rng = np.random.default_rng(3)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS), -2.0)
    words = ["abc", "Straße", "naïve", "x_1", "ΟΔΟΣ", "don't", "--", "\n"]
    long = " ".join(words[i] for i in rng.integers(0, len(words), 3000))
    texts = [long, "", None, "abc", "q" * 5000, long, "...", long[:777]]
    whole = model.score(texts, 10**9)
    for most in (1, 7, 100, 4096):
        assert "".join(toxicity.cut(long, most)) == long
        small = model.score(texts, most)
        assert small[0] == small[5]
        assert np.allclose(small, whole, rtol=0, atol=1e-12)
