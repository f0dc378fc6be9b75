"""Plain-Python checks of the numpy and string kernels, without Spark."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from sluice.llm import byte_bpe, classifier, common, line_dedup, nearest, packing, quality_rules, simhash, tiles, token_counts, wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", "é ü", "a b c", "x\n\n y\t z \x0b q", "漢字 🎉", "\x1c x", "A" * 5000, "w " * 3000]


def random_texts(seed, n, alphabet, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_and_hashes():
    texts = ODD + random_texts(1, 300, ["a", "b", " ", "\n", "\t", "é", " "])
    raw, bounds = common.text_bytes(pa.array([*texts, None]))
    start, end, at = common.word_spans(raw, bounds)
    data = raw.tobytes()
    words = [data[a:b].decode() for a, b in zip(start, end, strict=True)]
    for i, t in enumerate(texts):
        assert words[at[i] : at[i + 1]] == WORD.findall(t)
    h = common.hash_spans(raw, start, end)
    by_word = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_rows():
    bounds = np.array([0, 5, 5, 100, 101, 102])
    got = list(common.slices(bounds, 10))
    assert [x for a, b in got for x in range(a, b)] == list(range(5))


def brute_rules(text, limits=quality_rules.Limits()):
    w = WORD.findall(text)
    n = len(w)

    def covered(size):
        at = {}
        for i in range(n - size + 1):
            at.setdefault(tuple(w[i : i + size]), []).append(i)
        return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + size)})

    longest = 0
    for size in range(limits.min_repeat, n):
        seen = set()
        again = False
        for i in range(n - size + 1):
            key = tuple(w[i : i + size])
            again |= key in seen
            seen.add(key)
        if not again:
            break
        longest = size
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in quality_rules.SYMBOLS for c in text)
    chars = sum(map(len, w))
    repeat, spread = covered(8), covered(limits.min_repeat)
    failed = n < 20 or 100 * repeat > 30 * n
    bad = 100 * spread > limits.max_covered_percent * n or (longest > limits.free_repeat and 100 * longest > limits.max_longest_percent * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "repeat_covered": spread, "longest_repeat": longest, "base_failed": failed, "kept": not failed and not bad}


def test_quality_rules():
    rng = random.Random(2)
    texts = [t for t in ODD if len(t) < 4000]
    for _ in range(200):
        words = [rng.choice(["a", "b", "cé", "d#", "e", "f"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words += words[: rng.randint(0, 30)]
        texts.append("".join(w + rng.choice([" ", "\n", " \n "]) for w in words))
    raw, bounds = common.text_bytes(pa.array(texts))
    made = quality_rules.measure(raw, bounds, quality_rules.Limits())
    for i, t in enumerate(texts):
        assert {k: v[i] for k, v in made.items()} == brute_rules(t), t


def test_maximal_repeats():
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        subs = {}
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                subs.setdefault(tuple(w[i:j]), []).append(i)
        want = []
        for s, at in subs.items():
            left = {w[i - 1] if i else None for i in at}
            right = {w[i + len(s)] if i + len(s) < len(w) else None for i in at}
            if len(at) > 1 and (len(left) > 1 or 0 in at) and (len(right) > 1 or None in right):
                want.append((at, len(s)))
        assert quality_rules.maximal_repeats(w, 2) == sorted(want)


def brute_print(text, k=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in ODD + random_texts(3, 200, ["Ab", "c", " ", "\n", "É", "d "]):
        assert simhash.fingerprint(t.encode()) == brute_print(t)
    assert simhash.fingerprint(b"a b c d e f", 5) == brute_print("a b c d e f", 5)


def test_masks_leave_one_block():
    rng = random.Random(1)
    for blocks, distance in ((6, 4), (5, 3)):
        ms = tiles.masks(blocks, distance)
        for _ in range(500):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), distance):
                y ^= 1 << b
            assert any(x & m == y & m for m in ms)


def test_walk():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = np.array([b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(9)] + [rng.getrandbits(64)], np.uint64)
    seen = {}
    for g, group in enumerate(tiles.walk(prints, 4)):
        for i in group:
            assert i not in seen
            seen[int(i)] = g
    n = len(prints)
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if bin(int(prints[i]) ^ int(prints[j])).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    for i in range(n):
        for j in range(n):
            same = i == j or (i in seen and j in seen and seen[i] == seen[j])
            assert same == (label[i] == label[j])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    pairs = random_texts(6, 3000, "abc")
    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
        d = edits(a, b)
        for most in (d - 1, d, d + 1):
            if most >= 0:
                assert line_dedup.within(a, b, most) == (d <= most)


def test_lines():
    texts = ["Foo bar\n\nbaz  qux", "", "\n\n", "É a b c\nfoo BAR", "x\n"]
    whose, made = line_dedup.lines_of(texts)
    want = [(i, j, line) for i, t in enumerate(texts) for j, line in enumerate(t.split("\n")) if WORD.search(line)]
    assert [(i, j) for i, j, _ in want] == list(zip(whose.tolist(), made["line"].tolist(), strict=True))
    same = {}
    for (_, _, line), h in zip(want, zip(made["h1"].tolist(), made["h2"].tolist(), strict=True), strict=True):
        assert same.setdefault(line_dedup.normal(line), h) == h
    assert len(set(same.values())) == len(same)


def test_lines_by_definition():
    """Digests and fingerprints are those of each line's normal form and different words, whatever stands between words."""
    texts = [*ODD, *random_texts(12, 200, ["a", "bb", "a", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x85", "é", "İ"], 40), "a b " * 300 + "\n" + "a b " * 300]
    for part in (texts, texts[::-1], texts[:3], []):
        whose, made = line_dedup.lines_of(part)
        want = [(i, j, x) for i, t in enumerate(part) for j, x in enumerate(t.split("\n")) if WORD.search(x)]
        assert [(i, j) for i, j, _ in want] == list(zip(whose.tolist(), made["line"].tolist(), strict=True))
        for k, (_, _, x) in enumerate(want):
            normal = line_dedup.normal(x).encode()
            assert hashlib.blake2b(normal, digest_size=16).digest() == made["h1"][k].tobytes() + made["h2"][k].tobytes()
            raw, bounds = common.text_bytes(pa.array([b" ".join(set(normal.split())).decode()]))
            start, end, at = common.word_spans(raw, bounds)
            assert [made[c][k] for c in wide.COLUMNS] == wide.majority(common.hash_spans(raw, start, end), at).view(np.int64)[0].tolist()


def test_groups_of_similar_lines(monkeypatch):
    """Edits are counted only between lines that no bound over words links, nor a path of such links; what they link is found too."""
    base = [f"{c}{c}{c}{d}{d}" for c, d in zip("abcdefghijklmnopqrst", "bcdefghijklmnopqrstu", strict=True)]
    changed = lambda x, at: " ".join("z" + w[1:] if k in at else w for k, w in enumerate(x))
    texts = [changed(base, range(0)), changed(base, range(3)), changed(base, range(6)), "something else", changed(base, range(20))]
    asked = []
    monkeypatch.setattr(line_dedup, "within", lambda a, b, most, f=line_dedup.within: asked.append((a, b)) or f(a, b, most))
    found = lambda n: [set(g.tolist()) for g in line_dedup.alike(texts[:n], np.zeros((n, 4), np.uint64), line_dedup.Near())]
    assert found(4) == [{0, 1, 2}] and not asked
    assert found(5) == [{0, 1, 2, 4}] and asked


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


MIXED = ["a", "the", "ing", " ", "  ", "\n", "\t", " ", "é", "1", "!", "'s", "'", "\x1c", "\x85", "　", "ß", "漢", "🎉", "́", "​"]


def test_byte_bpe(codec):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ODD + random_texts(7, 3000, MIXED) + ["ab" * 4000, "<|endoftext|> x"]:
        ids = " ".join(codec.encode(t))
        assert ids == " ".join(map(str, library.encode_ordinary(t)))
        assert (codec.decode(ids) if ids else b"") == t.encode()


def test_token_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    counter, _ = token_counts.counter(P.path("piece_bpe_32k.model"))
    texts = [t for t in ODD + random_texts(8, 3000, [*MIXED, "▁", "▁▁", "aaaa", "==", "<s>", "</s>", "<unk>", "<0x0A>", "\x00"]) if t] + ["ab" * 4000, " " * 300 + "x", "=-" * 2000]
    flat, bounds = [], [0]
    for t in texts:
        flat += [token_counts.SPACE_MARK + x.replace(" ", token_counts.SPACE_MARK) for x in token_counts.parts_of(t)]
        bounds.append(len(flat))
    total = np.concatenate(([0], np.cumsum(counter.counts(flat))))
    got = [int(total[b] - total[a]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [len(x) for x in model.encode(texts, num_threads=1)]


def test_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = packing.Ids(P.path("word_bpe_49k.json"))
    texts = ODD + random_texts(9, 3000, [*MIXED, "İ", "Σ", "<|endoftext|>", "</w>", "ﬁ", "\r\n"])
    for got, t in zip(own(texts, 2), texts, strict=True):
        assert np.frombuffer(got, np.uint16).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_hilbert_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        key = packing.hilbert_keys(grid, bits)
        assert sorted(key.tolist()) == list(range(len(key)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_tail():
    assert packing.tail(4096 * 3 + 5, 4096).tolist() == [12288, 12292, 12293]
    assert packing.tail(0, 4096).tolist() == [0]


def test_tile_is_exact():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16)).astype(np.float32).astype(np.float64)
    v[50:90] = v[7]
    ids = rng.permutation(1000)[:300]
    for q, found, scores in nearest.tile(ids[:40], v[:40], ids, v, 5):
        i = int(np.flatnonzero(ids == q)[0])
        every = sorted((-sum(v[i] * v[j]), int(ids[j])) for j in range(300) if ids[j] != q)
        exact = nearest.dot(np.repeat(v[i : i + 1], 300, 0), v)
        want = sorted((-exact[j], int(ids[j])) for j in range(300) if ids[j] != q)[:5]
        assert [(-s, j) for s, j in zip(scores, found, strict=True)] == want
        assert [j for _, j in every[:1]] == found[:1]


def test_features_and_training():
    s = classifier.Settings(bits=12)
    good, bad = "the cat sat on a mat and %d" , "the%%% cat*** sat### on%%% a*** mat"
    texts = [(good % i, 1) for i in range(60)] + [(bad + " %%%" * (i % 5), 0) for i in range(60)]
    random.Random(1).shuffle(texts)
    examples = []
    for t, _ in texts:
        raw, bounds = common.text_bytes(pa.array([t]))
        places, at = classifier.features(raw, bounds, s.bits)
        assert at.tolist() == [0, len(places)]
        v, c = np.unique(places, return_counts=True)
        examples.append((v, c * s.scale / len(places)))
    w, b = classifier.train(examples, np.array([y for _, y in texts]), s)
    right = [(b + w[i] @ x > 0) == (y == 1) for (i, x), (_, y) in zip(examples, texts, strict=True)]
    assert all(right)
    raw, bounds = common.text_bytes(pa.array(["a b", "", None, "a b", "x"]))
    places, at = classifier.features(raw, bounds, s.bits)
    assert np.diff(at).tolist() == [3, 0, 0, 3, 1] and places[:3].tolist() == places[3:6].tolist()


def test_word_ids_of_all_characters():
    """Every character below U+3000 between letters, marks and numbers; every pair below U+0180; and odd mixtures: ids as the tokenizer's."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, library = packing.Ids(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    pool = "aAbE éÉßİıſKÅΣσςǅŉ'’.,!?\n\t\xa0 ́̇ﬁ12²½٣你"
    texts = [f"a{chr(c)}b {chr(c)}. {chr(c)}{chr(c)}'S x{chr(c)}'ll 1{chr(c)}2 !{chr(c)}?" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += [f"{chr(a)}{chr(b)}n " for a in range(0x180) for b in range(0, 0x180, 5)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b <|x|> <|startoftext|>.", "İ!", "don't WE'LL '’s", "''s '''t"]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(x, np.uint16).tolist() for x in own(texts, 2)] == [[*x.ids, 2] for x in want]


def test_long_pretokens(monkeypatch):
    """Counts of long pre-tokens as the library's, in time that grows with their length; short ones by the same way too."""
    import time

    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    rng = random.Random(3)
    count = lambda t: int(sum(pieces.counts([token_counts.SPACE_MARK + x.replace(" ", token_counts.SPACE_MARK) for x in token_counts.parts_of(t)])))
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 20000), ("ab", 5000), ("a", 9001), ("theinrgé ", 6000), ("a中\U0001f600", 3000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        assert count(text) == len(library.encode(text))
    began = time.perf_counter()
    count("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)))
    assert time.perf_counter() - began < 20
    monkeypatch.setattr(token_counts, "LONG", 3)
    monkeypatch.setattr(token_counts, "CHUNK", 5)
    for _ in range(200):
        text = "".join(rng.choice(rng.choice(["abc", "the ing", "a", "éaß中=-- "])) for _ in range(rng.randint(1, 60)))
        assert count(text) == len(library.encode(text))


def test_products_at_the_ends_of_numbers():
    """Vectors of any size and many components, and repeated ones: the nearest as by brute force."""
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=(300, 8)) * 1e160, rng.normal(size=(200, 3000)), rng.normal(size=(300, 4)) * 10.0 ** rng.integers(-320, 300, (300, 1)), np.repeat(rng.normal(size=(100, 1500)), 2, 0)):
        v = v[(v != 0).any(1)]
        ids = np.arange(len(v))
        for q, best, scores in nearest.tile(ids[::20], v[::20], ids, v, 20):
            with np.errstate(all="ignore"):
                s = nearest.dot(np.repeat(v[q : q + 1], len(v), 0), v)
            want = [i for i in np.lexsort((ids, -s)) if i != q][:20]
            assert best == want and np.array_equal(scores, s[want], equal_nan=True)


def test_repeats_by_words_alone():
    """Windows and lines that polynomial hashes don't tell apart, or that only look alike, aren't repeats."""
    a = "ab"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = f"{a}\n{b}\n{a}".encode()
    got = quality_rules.measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), quality_rules.Limits())
    assert got["n_dup_lines"].tolist() == [1]
