"""Conversation repair, source divergence and SentencePiece against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import divergence, pieces, repair

# --- conversation repair --------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, lost string, place long, blank long"


def turns(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            out[conv] += []
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(r, key=order) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every way to insert up to two turns in each gap and to edit each row."""
    best = None
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    edits = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        more = 3 * (fault == "truncated")
        own = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, [(role, text)])] + [("R", 3 + more, [(r, text)]) for r in ("user", "assistant")]
        edits.append(own)
    for choice in itertools.product(*edits):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in choice) + 3 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            audit, lines = "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(inserted[k])
                lines += [(r, "") for r in inserted[k]]
                if k < len(rows):
                    audit += choice[k][0]
                    lines += choice[k][2]
            initials = [r[:1] or "-" for r, _ in lines]
            if re.fullmatch("(s?(ua)+)?", "".join(initials)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
    return best


def brute_repair(rows):
    out = {}
    for conv, own in damage(rows).items():
        found, known = Counter(faults(own)), {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = cheapest(own)
        out[conv] = (conv, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(11)
    rows = []
    texts = ["Yes.", "no", "Ok! \t", " \n", "", None, "é?", "a.b"]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "agent"]
    for conv in [*range(40), None]:
        n = rng.choice([1, 1, 2, 2, 2, 3]) if conv is not None else 2
        rows += [(conv, rng.choice([0, 1, 2, 5, None]), rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts)) for _ in range(n)]
    rows += [(77, 0, "user", "Same."), (77, 0, "user", "Same.")]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "gone")]


def test_repair_is_the_cheapest(spark):
    broken = damage(conversations())
    rows = [r for r in conversations() if len(broken[r[0]]) <= 3]
    want = brute_repair(rows)
    got = {r[0]: tuple(r) for r in repair.conversation_repair(turns(spark, rows)).collect()}
    assert got == want
    assert any(w[7] == "" for w in want.values())
    assert repair.conversation_repair(turns(spark, [])).count() == 0


def test_repaired_turns(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["One.", "Two!", "three", ""])) for c in range(60) for t in range(rng.randint(1, 12))]
    broken = repair.damaged(turns(spark, rows))
    plans = repair.repair_plans(broken)
    lines = defaultdict(list)
    for r in repair.repaired_turns(broken, plans).orderBy("conv_id", "place").collect():
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append((r.role, r.text))
    for p in plans.collect():
        own = lines[p.conv_id]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == p.repaired_sha256


def test_long_conversation_takes_linear_time(spark):
    one = repair.Search()
    for k in range(50_000):  # every role equal: as many equally cheap ways as turns
        one.turn("user", b"x" * 20, k % 7 == 0, k % 5 == 0)
    cost, audit, _ = one.result()
    assert len(one.back) == 200_000 and cost > 0 and len(audit) >= 50_000
    long = [(1, t, ["user", "assistant"][t % 2], "word " * 20_000 + ".") for t in range(40)]
    got = repair.conversation_repair(turns(spark, long)).collect()
    assert [len(r.audit) >= 38 for r in got] == [True]


# --- source divergence ----------------------------------------------------------------------------------------------


def brute_divergence(rows, top):
    groups, total, docs, count = defaultdict(set), Counter(), Counter(), Counter()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        total.update((lang, w) for w in words)
        docs.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in docs.items() if x == lang and n >= 3]
        def shares(n):
            return {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(kept)) for w in kept}

        q = shares({w: total[lang, w] for w in kept})
        p = {s: shares({w: count[lang, s, w] for w in kept}) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def divergent():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcÉé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for k in range(300):
        s = rng.choice(["s0"] * 5 + ["s1", "s2", "Ü", None, "s5", "s6"])
        own = words[: 20 + 10 * (len(s or "") % 3)]
        rows.append((rng.choice([" ", "\n", "-1.", " AND "]).join(rng.choice(own) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None]), s))
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("rare words", "xx", "b"), ("once", "yy", "only")] + [("same same", "en", "s1")] * 5
    return [*rows, ("long " * 30_000, "fr", "s0")]


def test_divergence(spark):
    rows = divergent()
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, id int, block int, term string")
    for top, block in ((200, 256), (5, 2), (1, 1)):
        got = sorted(map(tuple, divergence.source_divergence(frame, top=top, block=block).collect()))
        assert got == brute_divergence(rows, top)
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(1)
    rows = [(c, c + rng.randint(1, 10**k)) for k in range(1, 15) for c in [rng.randint(0, 10**k) for _ in range(20)]]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in got)


# --- SentencePiece --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())


def odd_texts():
    rng = random.Random(7)
    alphabets = ["abcdefghij klmnop", " ", "▁ ae\n\té日👍\x00ß", "the in on er at ", "0123 456.,;", "aaaab", "=-*#/ \n"]
    texts = ["".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.2 else a) for _ in range(rng.randint(0, 80))) for a in alphabets for _ in range(60)]
    return [*texts, None, "", " ", "<s> </s> <unk> <0x41>", "a" * 20_000, " " * 3000 + "x", "日本" * 2000, "same", "same", "word, word. Word\n" * 3000]


def test_pieces_equal_the_library(spark, library):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    model = pieces.public_model()
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in pieces.piece_digests(rows, model).collect()}
    assert got == want
    back = pieces.piece_texts(pieces.piece_ids(rows, model), model).collect()
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in back)
    assert pieces.piece_digests(rows.limit(0), model).count() == 0


def test_decoding_any_ids(library):
    rng = random.Random(4)
    decoder = pieces.Decoder(pieces.vocabulary(pieces.public_model()))
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging():
    v = pieces.vocabulary(pieces.public_model())
    encoder = pieces.Encoder(v)
    rng = random.Random(9)
    chars = [c for c in "abcdehinorst▁.é日" if c in encoder.single]
    for _ in range(2000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(1, 25)))
        want = [encoder.usable[p] for p in pieces.merged(text, encoder.usable, v.ranks)[0]]
        assert encoder.encode_known(text) == want
