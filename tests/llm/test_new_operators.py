"""Packing, conversation repair and source divergence against brute force on small tables."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from passagework.llm import dialogue, divergence, packing, sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- packing


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return packing.read_vocabulary(tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encode(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_words_apart_give_the_ids_of_the_whole_text(vocabulary, encode):
    rng, words = random.Random(5), packing._Words(vocabulary)
    marks = [" ", "  ", "\n", "\t", "a", "Bé", "'s", " 's", "12", "!", " ", " ", "\x1c", "\x85", "<|endoftext|>", "日本", "😀", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(1, 40)))
        assert list(np.frombuffer(words.ids(text), "<u4")) == encode(text), text
    assert words.ids(None) == words.ids("") == b""


def test_cut_leaves_the_first_piece_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(4, 4) == [(0, 4)] and packing.cut(1, 4) == [(0, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(1, 65, 3000), rng.integers(1, 9, 500), np.full(300, 64), rng.integers(40, 65, 400), np.append(np.full(900, 25), rng.integers(1, 65, 900)), rng.integers(1, 65, 12)]
    lengths = kinds[seed]
    histogram = dict(collections.Counter(lengths.tolist()))
    plan = packing.pack_plan(histogram, 64)
    held = collections.Counter()
    for row, repeats in plan:
        assert sum(row) <= 64 and repeats > 0
        for n in row:
            held[n] += repeats
    assert dict(held) == histogram
    used = sum(r for _, r in plan)
    least = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))
    plain = sum(r for _, r in packing.best_fit(histogram, 64))
    assert used <= 1.02 * max(plain, least) + 2


def test_fit_finds_an_exact_cover():
    """A histogram made of exact patterns is fitted almost without residual."""
    patterns = packing.fill_patterns(np.arange(1, 32), 32)
    rng = np.random.default_rng(1)
    wanted = np.zeros(33)
    for p in rng.choice(len(patterns), 40, replace=False):
        np.add.at(wanted, patterns[p], 500.0)
    wanted[0] = 0
    x = packing.fit_counts(patterns, wanted, 32)
    got = np.zeros(33)
    for i in range(3):
        np.add.at(got, patterns[:, i], x)
    assert (x >= 0).all() and np.abs(got[1:] - wanted[1:]).sum() < 0.02 * wanted.sum()


def test_packed_pieces_fill_sequences_without_gaps(spark, vocabulary, encode):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta", "γάμμα", "x1", "\n"]) for _ in range(rng.choice([0, 1, 4, 9, 30, 200]))) for _ in range(150)]
    texts += [None, "", texts[7], texts[7]]
    rows = [(i if i != 5 else None, t, i, "x") for i, t in enumerate(texts)] + [(3, texts[3], 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, sequence_id string").repartition(5)
    found = packing.packed(docs, vocabulary, limit=32, keep_ids=True)
    got = [r.asDict() for r in found.collect()]
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = encode(text or "") + [2]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 32)):
            wanted[doc_id, piece, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for held in by.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [0, *itertools.accumulate(r["length"] for r in held)][:-1] and sum(r["length"] for r in held) <= 32
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(found).collect()}
    for key, held in by.items():
        assert whole[key] == [int(n) for r in held for n in np.frombuffer(bytes(r["ids"]), "<u4")]


def test_packing_of_nothing(spark, vocabulary):
    assert packing.packed(spark.createDataFrame([], "doc_id bigint, text string"), vocabulary).count() == 0


# ---- conversations


def cheapest(codes):
    """(cost, edits) by plain dynamic programming over strings."""
    far = (1 << 60, "")
    after, role = (2, 2, 3, 2), "uuau"
    best = [[far] * 4 for _ in range(len(codes) + 1)]
    for i in range(len(codes), -1, -1):
        row = [(0, "") if i == len(codes) and s in (0, 3) else far for s in range(4)]
        for _ in range(5):
            now = []
            for s in range(4):
                ways = [row[s], (row[after[s]][0] + 3, "I" + row[after[s]][1])]
                if i < len(codes):
                    initial, fault, rest = codes[i][:-1], codes[i][-1], best[i + 1]
                    ways.append((rest[s][0] + 4, "D" + rest[s][1]))
                    if fault != "d":
                        more = 3 * (fault == "t")
                        ways.append((rest[after[s]][0] + 3 + more, "R" + rest[after[s]][1]))
                        if initial == role[s]:
                            ways.append((rest[after[s]][0] + more, "K" + rest[after[s]][1]))
                        if initial == "s" and s == 0:
                            ways.append((rest[1][0] + more, "K" + rest[1][1]))
                now.append(min(ways))
            row = now
        best[i] = row
    return best[0][0]


def test_auction_finds_the_first_cheapest_edits_in_any_blocks():
    rng = random.Random(8)
    for _ in range(1500):
        codes = tuple(rng.choice(["u", "a", "u", "a", "s", "t", ""]) + rng.choice("--td") for _ in range(rng.choice([1, 2, 3, 5, 8, 20])))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randrange(4))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        cost, found = dialogue.join_blocks([dialogue.block_table(p) for p in parts])
        assert (cost, "".join(e for _, e in found)) == cheapest(codes), (codes, cuts)


def test_prices_are_dual_feasible_and_tight_along_the_trace():
    rng = random.Random(3)
    for _ in range(100):
        codes = tuple(rng.choice("uas") + rng.choice("--td") for _ in range(12))
        ends = (0, 1 << 50, 1 << 50, 0)
        price = dialogue.converged_prices(codes, ends)
        for i in range(13):
            for s in range(4):
                ways = [cost + price[i + step][to] for _, step, to, cost in dialogue.arcs(codes[i] if i < 12 else None, s)]
                assert price[i][s] == min([*ways, ends[s]] if i == 12 else ways)


def expected(rows):
    """conv_id -> the result's other columns, by a plain reading of the contract."""
    out, groups = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        show = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in held:
            full = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in held if t is not None}
        codes = [r[:1] + {"blank": "d", "duplicate": "d", "truncated": "t", "": "-"}[f] for (_, r, _), f in zip(held, faults)]
        cost, audit = cheapest(codes)
        lines, state, i = [], "", 0
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            name = held[i][1] if edit == "K" else "assistant" if state == "u" else "user"
            lines.append(f"{name}:{'' if edit == 'I' else held[i][2]}")
            i, state = i + (edit != "I"), name[:1]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_repair_equals_the_plain_reading(spark, block):
    rng = random.Random(4)
    texts = ["Yes.", "No", "Why?", " ", "", None, "line\nbreak!\n", "\x0b", "Ünï.", "dots... end", "a" * 300]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 4, 8, 25])):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += rows[:20]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, block int, edits string").repartition(4)
    found = dialogue.repaired(dialogue.damaged(table), block_rows=block).collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in found}
    assert len(found) == len(got) and got == expected(rows)


def test_repair_of_a_conversation_that_is_all_dropped_and_of_nothing(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kind = "conv_id bigint, turn bigint, role string, text string"
    row = dialogue.repaired(dialogue.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], kind))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dialogue.repaired(dialogue.damaged(spark.createDataFrame([], kind))).count() == 0


# ---- divergence


def divergences(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(fold(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: collections.Counter() for s in {d[1] for d in mine}}
        for _, s, words in mine:
            count[s].update(w for w in words if df[w] >= least)
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            words = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Über", "naïve", "ÇA", "it's", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(160):
        text = " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40, 120])))
        rows.append((rng.choice([text, text, text.upper()]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "Ü", "z", None])))
    rows += [(None, "en", "quiet"), ("", "fr", "lone"), ("one two", "xx", "p"), (None, "xx", "q"), ("1 2 3", "xx", "")]
    return rows + rows[:10]


@pytest.mark.parametrize("block", [64, 2])
def test_divergence_equals_brute_force(spark, spoken, block):
    table = spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(spoken)], "doc_id int, text string, lang string, source string, term string, n int").repartition(6)
    found = divergence.divergence(table, top=20, block=block)
    assert sorted(tuple(r) for r in found.collect()) == divergences(spoken, top=20)


def test_divergence_sql_equals_brute_force(spoken):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", spoken)
    assert sorted(con.sql(sql.OP13).fetchall()) == divergences(spoken)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
