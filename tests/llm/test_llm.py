"""The training-data operators against brute force, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import pickle
import random
import re
import struct
import time
import zlib
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import chat, components, decontam, html_text, langid, licenses, media, mixing, near_copies, pii, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, taken long"


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, 2, 3) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(50)]
    shared = text(60)
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])) for i, t in enumerate(base)]
    out += [(100 + i, base[0], "en", "a") for i in range(6)] + [(200 + i, base[1] + f" extra{i}", "en", "a") for i in range(6)]
    out += [(300 + i, text(20) + "\n" + shared + "\t " + text(i + 1), "fr", "b") for i in range(5)]
    out += [(400, None, None, None), (401, "", "en", "a"), (402, " \t\n\x0b", "en", "c"), (403, "one", "en", "c"), (403, "one", "en", "c"), (None, base[2], "en", None), (404, text(4000), "en", "a"), (405, "x " * 90, "en", "a"), (406, "12 % 3", "en", "d")]
    return out


def by_doc(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    s = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(spark, rows, monkeypatch):
    fps = [brute_fingerprint(t) for _, t, _, _ in rows]
    n = len(rows)
    same = [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2 or (rows[i][0] is not None and rows[i][0] == rows[j][0])]
    root = roots(n, same)
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    want = sorted([(i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(rows, fps, root)], key=repr)
    assert by_doc(simhash.simhash_groups(docs(spark, rows))) == want
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 2)  # every shared bucket is a large one
    assert by_doc(simhash.simhash_groups(docs(spark, rows))) == want
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_ids(spark):
    """Any 64-bit id; an id with several texts links them; groups without ids have none."""
    big = [(1 << 62) + 5, (1 << 63) - 1, -(1 << 63), -7]
    rows = [(i, f"text number {i} on its own", None, None) for i in big] + [(3, "a b c d", None, None), (5, "a b c d", None, None), (5, "w x y z", None, None), (9, "w x y z", None, None), (None, "lone p q r", None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.simhash_groups(docs(spark, rows)).collect())
    assert got == sorted([(False, i, i) for i in big] + [(False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 9, 3), (True, 0, None)])


def test_near_copies_take_any_row(spark):
    """Large ids, one id with several texts, rows without id, equal rows: one row of each group, the same in each run."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [((1 << 62) + 5, a, "en", "s"), (1, b, "en", "s"), (1, c, "en", "s"), (1, c, "en", "s"), (2, c + " more", "fr", "s"), (None, a, None, None), (None, None, None, None), (7, "", "en", "s"), (8, " ", "en", "s")]
    want = [((1 << 62) + 5, a), (1, b), (1, c), (7, "")]
    for parts in (1, 3):
        got = near_copies.one_of_each(docs(spark, rows).repartition(parts))
        assert got.columns == docs(spark, []).columns and sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)
    assert near_copies.one_of_each(docs(spark, [])).count() == 0


def test_wide_plan_reaches_its_goal():
    counts = np.full((65, 65), 2.5e8)
    counts[64, :] = counts[:, 64] = 5e8
    np.fill_diagonal(counts, 5e8)
    counts[64, 64] = 1e9
    lanes = near_copies.lanes_needed(10**9, near_copies.Fraction(4, 5)) - near_copies.CHECK_LANES
    parts = near_copies.wide_plan([counts] * lanes, near_copies.Fraction(4, 5))
    missed = np.prod([1 - near_copies._meeting(near_copies.bit_chance(near_copies.Fraction(4, 5)), len(p.bits), p.threshold) for p in parts])
    assert missed <= near_copies.MISS and len({(p.lane, b) for p in parts for b in p.bits}) == sum(len(p.bits) for p in parts)


@pytest.mark.parametrize("bits", [0, 1, 3, 7, 10])
def test_simhash_plans_lose_nothing(spark, bits, monkeypatch):
    rng = np.random.default_rng(bits)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = []
    for c in centers:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 8), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
    parts = simhash.plan(simhash.bit_counts(df)[0], bits)
    assert sum(p.threshold + 1 for p in parts) == bits + 1 and not sum(len(p.bits) for p in parts) > 64
    for size in (4096, 8):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", size)
        got = {r.node: r.root for r in components.components(simhash.links(df, bits)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_simhash_thresholds_are_unequal_when_that_pays():
    counts = np.zeros((65, 65))
    counts[64, 64] = 1e7
    counts[:64, 64] = counts[64, :64] = 5e6
    counts[:64, :64] = 2.5e6
    np.fill_diagonal(counts[:64, :64], 5e6)
    counts[:8, :64] = counts[:64, :8] = 0  # eight bits never set: no use to probe
    assert len({p.threshold for p in simhash.plan(counts, 4)} | {len(p.bits) for p in simhash.plan(counts, 4)}) > 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (100, 100), (5, 3), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def words13(text):
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()).split()


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_decontamination(spark, rows, block):
    items = [(1, rows[3][1]), (2, rows[300 % len(rows)][1]), (10, "one"), (3, "12 3"), (4, None), (5, "..."), (6, " ".join((rows[67][1] or "").split()[5:22])), (7, "One")]
    want = []
    for i, t, _, _ in rows:
        w = words13(t)
        hit, got = set(), set()
        for item, x in items:
            p = words13(x)
            k = min(13, len(p))
            windows = {tuple(p[a : a + k]) for a in range(len(p) - k + 1)} if k else set()
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    got.add(str(item))
        want.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows)
    assert by_doc(decontam.contamination(d, bench, block_windows=block)) == sorted(want, key=repr)
    kept = decontam.contamination(d, bench, block_windows=block, keep=True)
    assert kept.columns == d.columns and kept.count() == sum(not w[5] for w in want)
    assert not any(r.contaminated for r in decontam.contamination(d, bench.limit(0)).collect())
    assert decontam.contamination(d.limit(0), bench).count() == 0 and decontam.contamination(d.limit(0), bench, keep=True).count() == 0


def test_search_tables_are_small():
    """Bytes for each window at the production limit's density; unpickled in one piece."""
    rng = random.Random(1)
    items = [(str(i), [b"%d" % rng.randrange(50_000) for _ in range(200)]) for i in range(500)]
    (machine,) = decontam.machines(items)
    assert len(pickle.dumps(machine)) < 100 * 500 * 188
    assert list(machine.find(items[7][1][:13])) == [(0, ["7"])] and not list(machine.find(items[7][1][:12]))


@pytest.mark.parametrize("window,chunk,group", [(35, 10**6, 10**6), (35, 150, 40), (3, 200, 100), (1, 500, 50)])
def test_substrings(spark, rows, window, chunk, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_WINDOWS", group)
    count = Counter()
    for _, t, _, _ in rows:
        w = (t or "").encode().split()
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = []
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    cells = 1 if chunk == 150 else 16  # a small sketch overestimates much
    got = substrings.remove_repeats(docs(spark, rows), window, cells_per_anchor=cells, shard_anchors=100, chunk_words=chunk)
    assert by_doc(got) == sorted(want, key=repr)
    assert substrings.remove_repeats(docs(spark, []), window).count() == 0


def test_mixing(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    names = {}
    for i, _, _, s in rows:
        names.setdefault(i, s)
    taken, target, size = Counter(), {}, {}
    for r in got:
        taken[names[r.doc_id]] += r.taken
        target[names[r.doc_id]], size[names[r.doc_id]] = r.target, r.source_size
    assert sum(target.values()) == pytest.approx(sum(size.values())) and all(target[s] <= 3 * size[s] for s in target)
    assert all(abs(taken[s] - target[s]) <= max(8, 0.05 * target[s]) for s in target)
    assert by_doc(mixing.mix(docs(spark, rows).repartition(3))) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_targets_share_what_is_above(spark):
    rows = [("a", 10), ("b", 1000), ("c", 2), (None, 300)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    size, weight = dict(rows), {"a": 1, "b": 2, "c": 3, None: 1}
    level, capped = 0.0, set()
    while True:  # round by round
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in size if s not in capped and level * weight[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 3 * size[s] if s in capped else level * weight[s] for s in size})


def test_media(spark, rows):
    got = {}
    for r in media.text_media(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t, _, _ in rows:
        data = (t or "").encode()
        p = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    payload = bytes(range(192)) * 37
    data = media.pack(payload)
    (track,) = media.parse(data)
    assert b"".join(data[o : o + s] for o, s in track.samples()) == payload and [data[o : o + 3] for o, _ in track.keyframes()] == [payload[:3]] * 5
    files = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-40]),), (None,), (bytearray(b""),)], "content binary")
    out = media.media_columns(files).collect()
    assert out[0].tracks[0].codec == "raw " and out[0].tracks[0].duration == len(payload) and len(out[0].tracks[0].keyframes) == 5
    assert out[1].tracks is None and out[1].tracks_error and out[2].tracks is None and out[2].tracks_error is None and out[3].tracks == []


def fragmented(sizes, keys, base_flag):
    """A file with one track whose samples lie in two fragments; (file, samples, keyframes)."""
    box, full = media._box, media._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7)), box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide"), box(b"minf", stbl)))
    data = box(b"ftyp", b"isom") + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 40, 5, 0x10000))))
    samples, at_keys = [], []
    for part in (sizes[:2], sizes[2:]):
        def moof(offset):
            entries = b"".join(struct.pack(">II", n, 0 if n in keys else 0x10000) for n in part)
            run = full(b"trun", struct.pack(">Ii", len(part), offset), entries, flags=0x601)
            return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x020000 * base_flag), run))
        at = len(data) + len(moof(0)) + 8
        # the offset counts from the fragment's box, or from the end of the data before it
        data += moof(at - len(data)) + box(b"mdat", bytes(sum(part)))
        for n in part:
            samples.append((at, n))
            at_keys += [(at, n)] * (n in keys)
            at += n
    return data, samples, at_keys


def test_media_fragments_and_damage(spark):
    data, samples, keys = fragmented([10, 20, 30, 40], {10, 30}, True)
    (track,) = media.parse(data)
    assert (track.samples(), track.keyframes(), track.ticks, track.codec) == (samples, keys, 160, "avc1")
    whole = media.pack(bytes(range(192)) * 9)
    rng = random.Random(6)
    broken = []
    for source in (data, whole) * 150:
        b = bytearray(source)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.choice([0, 1, 255, rng.randrange(256)])
        broken.append((b[: rng.randrange(len(b))] if rng.random() < 0.3 else b, "x"))
    broken.append((bytearray(struct.pack(">I4s", 8, b"moov") + struct.pack(">I4sI4sI4sI4s", 32, b"moov", 24, b"trak", 16, b"mdia", 8, b"mdhd")), "x"))
    out = media.media_columns(spark.createDataFrame(broken, "content binary, tracks string")).collect()
    assert len(out) == 301 and all((r.tracks is None) != (r.tracks_error is None) for r in out) and out[-1].tracks_error
    assert media.media_columns(spark.createDataFrame([], "content binary")).count() == 0
    assert media.text_media(docs(spark, [])).count() == 0
    (long,) = media.text_media(docs(spark, [(1, "x" * 2_000_000, None, None)])).collect()
    assert long.n_bytes == 2_000_000 and long.payload_bytes == 2_000_064
    small = bytes([0, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 3, 0x12, 0x30])
    t = media.Track()
    media._walk(media._box(b"stz2", small), 0, 8 + len(small), t)
    assert t.sizes == [1, 2, 3]


def test_language(spark):
    rng = random.Random(2)
    letters = {"en": "etaoin", "fr": "éèauei", "de": "schüßn"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(200)), lang, "s") for i, lang in enumerate(rng.choices(list(letters), k=150))]
    rows += [(1000, None, "en", "s"), (1001, "12 %", "fr", "s"), (1002, "", None, "s"), (1003, "éèa", None, None), (None, "sch", "de", None)]
    got = {r.doc_id: r for r in langid.language_of(docs(spark, rows)).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in rows[:150] if got[i].held_out]
    assert right and sum(right) / len(right) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows[:154])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.known_language(docs(spark, rows))
    assert kept.count() == 152 and kept.columns == docs(spark, rows).columns
    assert all(r.lang == got[r.doc_id].lang_pred for r in kept.collect())
    strange = [(2000, "съешь ещё этих мягких французских булок " * 5, None, "s"), (2001, "これは日本語の文章です " * 9, None, "s"), (2002, "½ ² Ⅷ", "en", "s"), (2003, rows[0][1] + " 4444-12 token=9f8e7d", None, None)]
    left = {r.doc_id for r in langid.known_language(docs(spark, rows + strange)).collect()}
    assert left & {2000, 2001, 2002, 2003} == {2003} and {i for i, *_ in rows[:150]} <= left
    assert langid.predict(["½ ² Ⅷ", None, ""], langid.fit(docs(spark, rows))) == [("und", 0.0, True)] * 3
    assert langid.language_of(docs(spark, [])).count() == 0


def test_language_scores_are_bayes(spark, monkeypatch):
    """Batch scores against the formula, text by text, with more languages than a block holds, ties and equal texts."""
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("abc abd", "x"), ("abc", "y"), ("zzz q", "z"), ("éé", "w"), ("abc", None), ("", "v")])]
    texts = ["abc", "zq", "é", "abcabc zz", "Abc!", "nothing"]
    count, docs_of = {}, Counter()
    for _, t, lang, _ in rows:
        if lang and langid.has_letter(t):
            docs_of[lang] += 1
            for _, at in langid.grams([t]):
                count.setdefault(lang, np.full(langid.BUCKETS, 0.5))
                np.add.at(count[lang], at, 1)
    for size in (512, 2):
        monkeypatch.setattr(langid, "BLOCK_LANGUAGES", size)
        got = langid.predict(texts, langid.fit(docs(spark, rows)))
        for t, (lang, score, _) in zip(texts, got):
            logs = {k: np.log(docs_of[k] / 4) + sum(np.log(c / c.sum())[at].sum() for _, at in langid.grams([t])) for k, c in count.items()}
            best = max(logs.values())
            assert lang == min(k for k in logs if logs[k] == best) and score == pytest.approx(1 / sum(np.exp(v - best) for v in logs.values()))


PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two.<p>Three</article><footer>f</footer>": "A & B One two. Three",
    "<body><header>top</header><div class='main-text'><p>" + "long text " * 12 + "</p><p>Short.</p></div><div id=comments><p>" + "reader says " * 12 + "</p></div><aside>x</aside></body>": ("long text " * 12).strip() + " Short.",
    "<body><div class='cookie-notice'>We use cookies</div><script>var a = '<p>no</p>'</script><form>name</form><main><p>Body &lt;x&gt; &#233;.</p><style>p{}</style></main>": "Body <x> é.",
    "<p>only": "only",
    "": "",
    "<!-- <p>x</p> -->": "",
}


def test_html(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*PAGES, None])], "page_id long, url string, html string")
    got = [(r.text, r.n_chars) for r in html_text.page_texts(pages).orderBy("page_id").collect()]
    assert got == [(t, len(t)) for t in [*PAGES.values(), ""]]


def line_blocks(got):
    """The line-block method written out on lines that an extractor found, without its code."""
    within, every = sum(x.free for x in got if x.inside), sum(x.free for x in got)
    trusted = any(x.inside and x.text for x in got) and 2 * within >= every
    w = [(80 + x.free if x.inside and x.text else x.free / 4) if trusted else x.free for x in got]
    total = lambda i: sum(w[i : i + 3])
    kept, spans, i = set(), [], 0
    while i < len(got):
        j = i
        while j < len(got) and total(j) > 0:
            j += 1
        if j > i:
            spans.append((i, j))
        i = max(j, i + 1)
    surging = [s for s in spans if any(total(k) >= 80 for k in range(*s))] or sorted(spans, key=lambda s: (-sum(w[s[0] : s[1]]), s[0]))[:1]
    for i, j in surging:
        own = [k for k in range(i, j) if got[k].text]
        strong = [k for k in own if w[k] >= 40 or got[k].prose and got[k].free] or own
        kept |= {k for k in own if strong[0] <= k <= strong[-1]}
    boxes = {got[k].box for k in kept if got[k].inside or not trusted}
    kept |= {k for k, x in enumerate(got) if x.text and x.prose and x.free and x.box in boxes}
    return " ".join(got[k].text for k in sorted(kept))


def test_html_is_line_blocks():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "bcd", "efghi", "jklmnopq", "&amp;", "&#233;"])
    tags = ["p", "div", "h2", "li", "a", "nav", "article", "main", "section", "b", "script", "td", "div class=ad", "div id=content"]
    for _ in range(400):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", *[" ".join(word() for _ in range(rng.choice([1, 3, 30])))] * 2]) for _ in range(rng.randint(1, 30)))
        assert html_text.main_text(page) == line_blocks(html_text.lines(page))


def test_html_surge_and_dive_decide():
    story = "<p>" + "a story told at length " * 10 + "</p>"
    text = ("a story told at length " * 10).strip()
    # menus that no tag or name marks, before and after; links in main; a story beside main
    assert html_text.main_text(f"<body><div>Home</div><div>About us page</div><div>{story}</div><div><a>next</a></div><div>Imprint</div>") == text
    assert html_text.main_text(f"<main><p><a>Menu one</a></p><p><a>Menu two</a></p></main><div>{story}</div>") == text
    assert html_text.main_text(f"<article>{story}<p>End.</p></article><div>short note outside</div>") == text + " End."
    # what stands in one container stays together, whatever lies between
    assert html_text.main_text(f"<div><h1>Title</h1><script>x</script>{story}<div class=ad>buy</div><p>Short.</p><form>f</form><p>Last.</p></div>") == f"Title {text} Short. Last."
    assert html_text.main_text("<div>only words</div>") == "only words"


@pytest.mark.parametrize("bad", ["<b>", "<a ", "<div><p>", "<a x='", "</b>", "<", "<!--", "&amp", "<a \"'", "<header>", "<article>", "-list", "x=y"])
def test_html_is_linear_on_hostile_markup(bad):
    at = time.perf_counter()
    html_text.main_text("<p class=" + bad * 30_000 + ">" if bad in ("-list", "x=y") else bad * 30_000 + '"')
    assert time.perf_counter() - at < 5


def test_html_rows(spark):
    """Repeated rows, clashing columns, null ids, a very long page, an empty table."""
    rows = [(1, "u", "<p>x</p>", "t", 1), (1, "u", "<p>x</p>", "t", 1), (None, None, None, None, None), (2, "u", "<p>" + "word " * 200_000 + "</p>", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.n_chars) for r in html_text.page_texts(pages).collect()) == [(0, 0), (1, 1), (1, 1), (2, 999_999)]
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_licenses(spark):
    assert licenses.evaluate("(GPL-2.0-only WITH Classpath-exception-2.0) OR Apache-2.0 AND MIT") == ({"gpl", "apache", "mit"}, 1.0)
    assert licenses.postfix("MIT or Zlib and GPL-2.0 with GCC-exception") == ["MIT", "Zlib", "GPL-2.0", "GCC-exception", "with", "and", "or"]
    assert licenses.evaluate("MIT or any later version") == ({"mit"}, 1.0) and licenses.evaluate("BSD-3-Clause and see below") == ({"bsd"}, 1.0)
    for bad in ("", "MIT AND", "(MIT", "AND MIT", "see LICENSE", "(MIT or what"):
        with pytest.raises(ValueError):
            licenses.postfix(bad)
    texts = ["MIT License, mit-license Apache  LICENSE é", None, "", "x // SPDX-License-Identifier: LGPL-3.0-or-later OR MIT\ny", "cc by cc by", "commit license"]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = [x.decode() for x in words13(t)]
        at = [(k, lab) for k in range(len(w)) for p, lab in licenses.BASE.items() if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (got[i].first_word, got[i].last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert got[3].labels == "lgpl,mit" and got[3].score == 1.0


def brute_labels(text):
    """Labels of notices found word by word: base phrases, and the longest notice at each place."""
    w = [x.decode() for x in words13(text)]
    out = set()
    for k in range(len(w)):
        here = [p for p in {**licenses.NOTICES, **licenses.BASE} if w[k : k + len(p.split())] == p.split()]
        out |= {licenses.BASE[p] for p in here if p in licenses.BASE}
        if here:
            p = max(here, key=len)
            out.add(licenses.BASE.get(p) or licenses.NOTICES[p])
    return ",".join(sorted(out))


def test_licenses_by_brute_force(spark):
    rng = random.Random(3)
    phrases = [*licenses.BASE, *licenses.NOTICES, "gnu", "license", "cc", "by", "creative commons"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice([p, p.upper(), "word"]) for p in rng.choices(phrases, k=rng.randint(1, 12))) for _ in range(300)] + ["mit license " * 50_000, "mit license", "mit license"]
    got = licenses.license_scan(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts) and all(r.labels == brute_labels(texts[r.doc_id]) for r in got if r.doc_id < 300 or r.doc_id > 300)
    assert next(r for r in got if r.doc_id == 300).n_base == 50_000
    assert all(r.score == min((licenses.FREEDOM[x] for x in r.labels.split(",") if x), default=0.0) or "cc-by" in r.labels or "gpl" in r.labels for r in got)
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_pii(spark):
    key = b"k"
    text = 'Mr John Smith and Anna Schmidt: john.smith19@mail5.example.com, +1 (743) 555-3824, 4111 1111 1111 1111 and 4111111111111111, 192.168.1.10, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Dr. Smith.'
    s = pii.Surrogates(key)
    new, found = pii.surrogate_text(text, s)
    assert not any(x in new for x in ("Smith", "John ", "john", "555-3824", "4111", "192.168.1.10", "04dbebab"))
    assert new.count(s.name("Smith")) == 2 and s.name("Smith").lower() == s.name("smith") and s.name("SMITH") == s.name("Smith").upper()
    cards = [e.surrogate.replace(" ", "") for e in found if e.kind == "card"]
    assert all(pii.is_card(s.replace("card", x)) for x in ("4111111111111111", "5555555555554444", "378282246310005", "6011111111111117", "30569309025904"))
    assert cards[0] == cards[1] and pii.luhn(cards[0][:-1]) == cards[0][-1]
    assert next(e.surrogate for e in found if e.kind == "given") in pii.GIVEN["m"] and pii.clashes(found) == 0
    assert sorted(s.permuted(i, 1000, b"t") for i in range(1000)) == list(range(1000))
    for clean in ("on 2024-01-02 at 3.14159, v1.2.3", "Mr Speaker, the password: required", "version 3.4.5.6 of it", "order 9807915762804490 of 4845168114407328", "Anna went home", "", "Mr"):
        assert pii.surrogate_text(clean, s)[0] == clean
    many = [(i, f"call +1 ({200 + i % 7}) 555-{i:04d} or u{i}@x.org from 10.0.0.{i % 250}", None, None) for i in range(500)]
    d = docs(spark, [*many, (None, None, None, None), (501, "", None, None), (501, "", None, None)])
    assert pii.conflicts(d, key).count() == 0
    out = pii.with_surrogates(d, key)
    assert out.columns == d.columns and out.count() == 503
    rows = pii.personal_data(d, key).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 503 and len({r.text for r in got.values()}) == 502 and got[None].text is None and got[501].n_entities == 0 and got[3].n_entities == 3
    assert all(re.search(r"from 10\.\d+\.\d+\.\d+$", got[i].text) for i in range(500)) and not any(r.n_clashes for r in rows)
    assert pii.personal_data(d.limit(0), key).count() == 0 and pii.with_surrogates(d.limit(0), key).count() == 0


@pytest.mark.parametrize("size", [10, 64, 65, 129, 1000, 100_000])
def test_pii_long_values_leave_no_trace(size):
    """All of a long value is exchanged, in its own shape, in reasonable time; near values get far surrogates."""
    rng = random.Random(size)
    s = pii.Surrogates(b"k")
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789") for _ in range(size - 1)) + "1"
    text = f'private_key = "{value}" and Dr {"A" + "b" * size} or {"q" * size}@mail.org'
    new, found = pii.surrogate_text(text, s)
    assert [e.kind for e in found] == ["secret", "name", "email"]
    out = found[0].surrogate
    assert len(out) == size and all(a.isupper() == b.isupper() and a.isdigit() == b.isdigit() for a, b in zip(value, out))
    assert sum(a == b for a, b in zip(value, out)) < size * 0.25 + 4 and not any(value[i : i + 8] in new for i in range(0, size - 8, max(1, size // 500)))
    other = s.replace("secret", value[:-1] + "2")
    assert other != out and sum(a == b for a, b in zip(other, out)) < size * 0.25 + 4


def test_pii_coreference_and_formats():
    s = pii.Surrogates(b"k")
    forms = ["+17435553824", "+1 743 555 3824", "+1 (743) 555-3824", "743-555-3824", "(743) 555-3824"]
    new = [s.replace("phone", f) for f in forms]
    assert len({pii.phone_parts(x)[1] for x in new}) == 1 and len({pii.canonical("phone", x) for x in new}) == 2
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(forms, new))
    arabic = s.replace("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨")
    assert len(arabic) == 16 and arabic.startswith("+٤٤ ") and all(c in "+ ٠١٢٣٤٥٦٧٨٩" for c in arabic)
    for text, gone in [("Mr John Smith came. Smith said, and SMITH wrote: smith!", "smith"), ("MR JOHN SMITH SPOKE to Smith", "smith"), ("Fatima Al-Sayed met Priya Sharma; Sharma left", "sharma"), ("Иван Петров и Петров", "петров"), ("Wei Zhang, Zhang", "zhang"), ("г-жа Орлова, Орлова", "орлова")]:
        assert gone not in pii.surrogate_text(text, s)[0].lower(), text
    assert pii.surrogate_text("Иван Петров", s)[0].split()[0] in pii.GIVEN["m"]
    # exact: all names up to three letters, all short hexadecimal secrets, all of a phone's last digits
    names = [a + b + c for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in ["", *"abcdxyz"]]
    assert len({s.name(x) for x in names}) == len(names)
    hexes = [f"{i:x}".zfill(3) for i in range(4096)]
    assert len({s.replace("secret", x) for y in hexes for x in {y, y.upper()}}) == len({x for y in hexes for x in {y, y.upper()}})
    assert len({s.replace("ip", f"8.8.{i}.{j}") for i in range(8) for j in range(256)}) == 2048


def test_chat(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (3, 0, "user", None), (4, 0, "user", "z"), (4, 1, "assistant", "y"), (None, 0, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.chosen_id, r.rejected_id): r for r in chat.preference_format(chat.conversation_pairs(df)).collect()}
    assert set(got) == {(1, 2), (3, 3), (4, 4)}
    r = got[1, 2]
    assert (r.prompt_turns, r.prompt) == (1, "<|user|>\nq<|end|>\n")
    assert [r.chosen_text[int(a) : int(b)] for a, b in (x.split("-") for x in r.chosen_mask.split(","))] == ["a<|end|>\n", "b<|end|>\n"]
    assert got[4, 4].rejected_text == "<|assistant|>\nz<|end|>\n" and (got[3, 3].chosen_text, got[3, 3].rejected_mask) == ("", "")
    assert chat.conversation_pairs(df.limit(0)).count() == 0


def test_pipeline(spark, rows, tmp_path):
    d = docs(spark, rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs_now = stage(spark, docs_now, str(tmp_path))
        if name != "mixing":
            assert sorted(docs_now.columns) == sorted(d.columns)
        docs_now.write.parquet(str(tmp_path / name))
        docs_now = spark.read.parquet(str(tmp_path / name))
        sizes.append({r[0] for r in docs_now.select("doc_id").collect()})
    language, near, clean, private, mixed = sizes
    assert {i for i, t, _, _ in rows} - language == {400, 401, 402, 406}
    assert {100, 101, 102, 103, 104, 105}.isdisjoint(near) and 0 in near and len(near & {1, *range(200, 206)}) == 1
    assert 5 not in clean and clean == private == mixed
    far = [(a, b) for a in near for b in near if a and b and a < b and a < 50 and b < 50]
    text = {i: t for i, t, _, _ in rows}
    assert all(SequenceMatcher(None, text[a].split(), text[b].split()).ratio() < 0.95 for a, b in far[:200])


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def spread_pairs(n, seed=11):
    """Pairs of English documents whose five-word shingles have similarities spread over 0.7 to 0.95; ids 2 i and 2 i + 1."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(150, 400))]
        want = 0.7 + 0.25 * i / n
        other, places = list(w), rng.sample(range(len(w)), len(w))
        while (s := len(a := five_words(" ".join(w)) & five_words(" ".join(other))) / (2 * len(w) - 8 - len(a))) > want:
            other[places.pop()] = word()
        out += [(2 * i, " ".join(w), "en", "a"), (2 * i + 1, " ".join(other), "en", "a")]
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_near_copies_are_those_of_exact_similarity(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16 * block)
    pairs = spread_pairs(120)
    copies = [(1000 + i, pairs[0][1] + f" tail{i}", "en", "a") for i in range(9)]  # one group of several blocks
    rows = [*pairs, *copies, (None, pairs[0][1], "en", "a")]
    sets = [five_words(t) for _, t, _, _ in rows]
    n = len(rows) - 1
    root = roots(n, [(i, j) for i in range(n) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    want = {rows[i][0] for i in range(n) if root[i] == i}
    assert 160 < len(want) < 200
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    if block == 256:
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == want


@pytest.mark.parametrize("name", ["has-sidebar", "content-with-sidebar", "no-footer", "layout-header", "side-by-side", "header", "page sidebar"])
def test_html_layout_names_hide_no_main_text(name):
    body = "plain words " * 20
    for inner in (f"<article><p>{body}</p></article>", f"<main><p>{body}</p></main>", f"<p>{body}</p>"):
        related = "" if inner[1] == "p" else f"<section class=related><article><p>{'other ' * 30}</p></article></section>"
        page = f"<body><div class='{name}'><div id=menu>Menu</div>{inner}</div><div class='nav-links'>next page</div>{related}</body>"
        got = html_text.main_text(page)
        assert got == body.strip()


def test_pipeline_stages_take_nulls_and_empty_tables(spark, tmp_path):
    """Every stage on an empty table, and on nulls, empty and equal rows that a stage before might keep."""
    spark.createDataFrame([(None, "x y"), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None), (1, None, None, None), (2, "", "en", None), (2, "", "en", None), (None, "words here", None, "s"), (3, "words here", "xx", "s")]
    left = {"language": {None, 3}, "near_duplicates": {1, 3}, "decontamination": {None, 1, 2, 3}, "personal_data": {None, 1, 2, 3}, "mixing": {None, 1, 2, 3}}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs(spark, []), str(tmp_path))
        assert none.count() == 0 and (name == "mixing" or none.columns == docs(spark, []).columns)
        assert {r.doc_id for r in stage(spark, docs(spark, odd), str(tmp_path)).collect()} == left[name], name


def test_preference_format_takes_nulls(spark):
    schema = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_turns int"
    rows = [(1, None, None, 9), (2, [("user", None), None], [("user", "")], 9), (3, [("assistant", "a")], None, 9)]
    got = {r.id: (r.prompt_turns, r.chosen_text, r.rejected_text) for r in chat.preference_format(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (0, "", ""), 2: (1, "", ""), 3: (0, "<|assistant|>\na<|end|>\n", "")}
