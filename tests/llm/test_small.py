"""Parts of the operators that need no cluster."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import induced, repeats, substring_bytes, substring_words
from millrace.llm.language_id import Index, Model, windows
from millrace.llm.mixing import pattern, shares
from millrace.llm.packing import Plan, column_generation, price
from millrace.llm.simhash import BKTree, fingerprint
from millrace.llm.surrogates import Permuter, Surrogates, luhn, mod_97
from millrace.llm.token_files import TokenFile, encode_file
from millrace.llm.tokens import MemoEncoder, default_vocabulary
from millrace.llm.topk import search_chunk


@pytest.fixture(scope="module")
def encoder():
    return MemoEncoder(default_vocabulary(), memo_words=50)


TRICKY = ["a", "b", ".", ",", "'", "!", "$", " ", "\n", "\t", "\xa0", "é", "ß", "_", "1", "<|", "|>", "<|endoftext|>", "'s", "  ", "...", "\0", "漢", "🙂", "x.y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TRICKY), max_size=12).map("".join), max_size=4))
def test_memo_encoding_is_exact(encoder, texts):
    expected = [np.asarray(encoder._tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == expected
    assert encoder.encode([None]) == [b""]


def test_long_texts_are_encoded_exactly(encoder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuéüß", k=rng.randint(1, 12))) + rng.choice(["", "", "", ",", ".", "$$$", "'s", "!,"])
    texts = [" ".join(word() for _ in range(400)).replace(". ", ".\n") for _ in range(30)]
    expected = [np.asarray(encoder._tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1)), max_size=1500), st.integers(0, 4))
def test_token_file_round_trip(ids, cuts):
    ids = np.array(ids, np.uint32)
    at = sorted(random.Random(len(ids)).choices(range(len(ids) + 1), k=cuts))
    starts = np.array([0, *at, len(ids)])
    names = [None, *range(len(starts) - 2)]
    got = TokenFile(encode_file(names, starts, ids))
    assert got.doc_ids == names and got.n_tokens == len(ids)
    assert (got.slice(0, len(ids)) == ids).all()
    for i in range(0, len(ids), 7):
        assert got.token(i) == ids[i]
    for k in range(len(names)):
        assert (got.document(k) == ids[starts[k] : starts[k + 1]]).all()
    with pytest.raises(IndexError):
        got.token(len(ids))


def test_other_bytes_are_no_token_file():
    with pytest.raises(ValueError):
        TokenFile(b"x" * 64)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_packing_plan_places_every_piece_once(demand):
    plan = Plan(demand, 64, 2)
    fill = {}
    for length, n in demand.items():
        sequence, offset = plan.places(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            parts = [(s, o, 0, length)] if s >= 0 else list(plan.cuts(o, length))
            assert parts[0][2] == 0 and parts[-1][3] == length and all(a[3] == b[2] for a, b in zip(parts, parts[1:]))
            for where, begin, a, b in parts:
                fill.setdefault(where, []).append((begin, begin + b - a))
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        end = spans[-1][1]
        assert 64 - 2 <= end <= 64 or end & (end - 1) == 0


def test_pricing_and_column_generation():
    lengths = np.array([3, 5, 7])
    worth, counts = price(np.array([3.0, 5.5, 7.0]), lengths, 10)
    assert worth == 11.0 and counts == {1: 2}
    found = column_generation({6: 100, 4: 100, 10: 7}, 10)
    assert abs(sum(x for _, x in found) - 107) < 1e-6
    assert column_generation({}) == []


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[counts[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=50).map(str.encode), min_size=1, max_size=6), st.integers(1, 9), st.sampled_from([1, 1 << 20]))
def test_induced_sorting_finds_all_repeats(texts, length, memory):
    assert [x.tolist() for x in induced.repeated_windows(texts, length, memory)] == brute(texts, length)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=120), st.integers(4, 40))
def test_suffixes_come_in_falling_order_with_their_common_prefixes(text, cap):
    raw = text.encode()
    symbols = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 2, 0).astype(np.uint16)
    places = []
    for positions, values in induced.sorted_suffixes(symbols, cap):
        for i, (p, v) in enumerate(zip(positions.tolist(), values.tolist())):
            if i:
                a, b = raw[p:], raw[places[-1] :]
                same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert min(same, cap) == v
            places.append(p)
    assert sorted(places) == list(range(len(raw)))
    cuts = [raw[p : p + cap] for p in places]
    assert cuts == sorted(cuts, reverse=True)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=5), st.integers(1, 7))
def test_fixed_blocks_find_all_repeated_passages(texts, window):
    data, sizes = substring_words._join([" ".join(t) for t in texts])
    raw = np.frombuffer(data, np.uint8)
    starts, ends = substring_words.word_bounds(raw)
    seg = substring_words.stretches(window, (window + 1) // 2)(raw, sizes, lambda hashes: np.ones(len(hashes), bool))
    cut = [data[starts[p] : ends[p + n + window - 2]] for p, n in zip(seg.place.tolist(), seg.n.tolist())]
    groups = np.unique(seg.hash, return_inverse=True)[1]
    flags = substring_words.repeated_windows(cut, np.ones(len(cut), int), seg.offset, groups, window) if cut else []
    again = set()
    for p, found in zip(seg.place.tolist(), flags):
        again.update((np.flatnonzero(found) + p).tolist())
    at, got = 0, []
    for t in texts:
        got.append([at + i in again for i in range(len(t) - window + 1)])
        at += len(t)
    assert got == brute([tuple(t) for t in texts], window)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    passage = "".join(rng.choices("abcd", k=60))
    whole = "".join(rng.choices("abcd", k=500)) + passage + "".join(rng.choices("abcd", k=300)) + passage + "x" * 100
    by_window = {}
    for size in (1 << 21, 100):
        seg = substring_bytes.anchors(20, 6, size)(np.frombuffer(whole.encode(), np.uint8), np.array([400, len(whole) - 400]))
        assert seg.n.sum() == len(whole) - 2 * 20 + 2
        for place, n, offset, anchor in zip(*(x.tolist() for x in (seg.place, seg.n, seg.offset, seg.hash))):
            for i in range(place, place + n):
                assert by_window.setdefault(whole[i : i + 20], (anchor, offset - (i - place))) == (anchor, offset - (i - place))
    assert not repeats.covered(5, None, None, None, 3).any()
    flags = np.array([1, 1, 1, 0, 1], bool)
    assert [x.tolist() for x in repeats.spans_of(flags, np.array([0, 2, 0, 3]))] == [[1, 3, 3], [0, 0, 2], [2, 1, 3]]


def test_queues_go_to_disk_in_a_shard_of_the_query(monkeypatch):
    spilled = []
    spill = induced.Queues._spill
    monkeypatch.setattr(induced.Queues, "_spill", lambda self: (spilled.append(1), spill(self)))
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 122, 350, np.uint8).tobytes() for _ in range(repeats.SHARD_BYTES // 350)]
    texts[5] = texts[9]
    got = induced.repeated_windows(texts, 200, counts=np.arange(len(texts)) // 7 % 2 * 3)
    assert spilled
    for i, found in enumerate(got):
        assert found.all() == (i in (5, 9) or i // 7 % 2 == 1) and found.any() == found.all()


def test_bk_tree_links_are_those_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64(1 << int(i)) for i in range(0, 64, 5)] + [base]))
    links = {(a, b) for a, near in BKTree(values).links(2) for b in near.tolist()}
    expected = {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert links == expected


def test_fingerprint_of_few_words():
    assert fingerprint(None) == fingerprint(" \t") == 0
    assert fingerprint("One two") == fingerprint("ONE\x0btwo ") != 0


def test_code_lengths_leave_room_for_every_byte():
    rng = np.random.default_rng(2)
    model = Model({x: np.unique(windows(rng.integers(0, 6, 3000, np.uint8).tobytes()), return_counts=True) for x in "ab"})
    for context in ([0, 1, 2], [0, 9, 1], [200, 0, 1], [7, 8, 9]):
        keys = np.array([context[0] | context[1] << 8 | context[2] << 16 | x << 24 for x in range(256)], np.uint32)
        assert (np.exp2(-model._lengths(keys).astype(float)).sum(axis=0) <= 1 + 1e-4).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40), st.lists(st.integers(0, 2**32 - 1), max_size=10))
def test_index_finds_its_keys(known, others):
    known = np.unique(np.array(known, np.uint32))
    index = Index(known)
    ask = np.concatenate([known, np.array(others, np.uint32)])
    at = index.find(ask)
    assert [int(known[index.order[i]]) if i >= 0 else None for i in at] == [int(x) if x in known else None for x in ask]


def test_a_model_without_languages_knows_nothing():
    assert Model({}).predict(["text", None]) == (["und", "und"], [0.0, 0.0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_every_prefix_of_a_cycle_is_within_one_block(weights):
    share = shares({f"s{i}": float(w) for i, w in enumerate(weights)}, 97)
    assert sum(share.values()) == 97
    slots = pattern(share)
    assert sorted(t for v in slots.values() for t in v) == list(range(97))
    for s, a in share.items():
        for t in range(1, 98):
            assert abs(sum(1 for x in slots[s] if x < t) - a * t / 97) < 1


def test_surrogates_are_consistent_distinct_and_of_the_same_format():
    for bound in (1, 2, 3, 10, 36, 257):
        p = Permuter(b"k")
        image = [p.number(i, bound, b"t") for i in range(bound)]
        assert sorted(image) == list(range(bound)) and (bound == 1 or all(i != x for i, x in enumerate(image)))
    make = Surrogates(b"key")
    text = "Herr Karl, Frau Émilie: a.b@mail1.example.com +1 (988) 555-2485 10.0.0.1 4539578763621486 token = \"0ab1c2d3e4f5\" a.b@mail1.example.com 999.1.1.1"
    new, found = make.replace(text)
    kinds = [k for _, _, k, _, _ in found]
    assert kinds == ["name-m", "name-f", "email", "phone", "ip", "card", "secret", "email"]
    assert found[2][4] == found[7][4] and all(old != made for _, _, _, old, made in found)
    assert all(old not in new for _, _, k, old, _ in found if k != "ip") and "999.1.1.1" in new
    assert luhn(found[5][4]) and len(found[5][4]) == 16 and new.index("+1 (") > 0
    assert all(sum(c.isdigit() for c in old) == sum(c.isdigit() for c in made) for _, _, k, old, made in found if k in ("phone", "card"))
    assert make.replace(None) == (None, []) and make.replace("nothing here")[0] == "nothing here"
    assert Surrogates(b"other").replace(text)[0] != new


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(0, 99))
def test_block_pruning_is_exact(n, k, seed):
    rng = np.random.default_rng(seed)
    vectors, ids = rng.integers(-3, 4, (n, 5)), np.arange(n)
    blocks = [(ids[i : i + 7], vectors[i : i + 7]) for i in range(0, n, 7)]
    got, _ = search_chunk(vectors[:4], ids[:4], blocks, k)
    for q, (scores, found) in enumerate(got):
        every = sorted((-int(vectors[q] @ vectors[j]), int(j)) for j in range(n) if j != q)[:k]
        assert [(-s, j) for s, j in zip(scores.tolist(), found.tolist())] == every


def test_pruning_skips_blocks():
    rng = np.random.default_rng(5)
    blocks = [(np.arange(i * 50, i * 50 + 50), rng.integers(0, 3, (50, 6)) + (40 if i == 3 else 0)) for i in range(8)]
    _, scored = search_chunk(np.ones((1, 6), np.int64), np.array([-1]), blocks, 5)
    assert scored == 1


def test_crc_is_unsigned():
    assert zlib.crc32(b"\xff" * 8) >= 0


def test_names_of_several_words_scripts_and_mentions_and_national_phones():
    make = Surrogates(b"key")
    text = "Mr John Smith met Frau Anna Müller, Prof. Dr. Petrović, M. Dupont and Mme Curie. Later Smith left; Petrović stayed. Господин Иванов, Κυρία Παππά. 06 12 34 56 78 or 030 1234567."
    new, found = make.replace(text)
    names = [old for _, _, kind, old, _ in found if kind.startswith("name-")]
    assert names == ["John", "Smith", "Anna", "Müller", "Petrović", "Dupont", "Curie", "Smith", "Petrović", "Иванов", "Παππά"]
    assert all(text[a:b] == old and old not in new and old != made and len(old) == len(made) or old in ("John", "Anna") for a, b, _, old, made in found)
    assert found[1][4] == found[7][4] and found[4][4] == found[8][4]
    assert [old for _, _, kind, old, _ in found if kind == "phone"] == ["06 12 34 56 78", "030 1234567"]
    assert all("Ѐ" <= c <= "ѿ" for c in found[9][4])
    assert make.replace("Mr a@b.example.com")[1][0][2] == "email"
    assert [x[3] for x in make.replace("Mr John.Smith@b.example.com wrote")[1]] == ["John.Smith@b.example.com"]


def test_accounts_keep_their_check_digits_and_addresses_their_groups():
    make, seen = Surrogates(b"key"), set()
    for n in range(300):
        body = f"370400440532013{n:03d}"
        valid = f"DE{98 - mod_97('DE00' + body):02d}{body}"
        wrong = f"DE{(98 - mod_97('DE00' + body)) % 97 + 2:02d}{body}"
        assert mod_97(valid) == 1 != mod_97(wrong)
        for iban in (valid, wrong):
            (entity,) = make.replace(f"to {iban}, please")[1]
            assert entity[2] == "iban" and entity[4][:2] == "DE" and (mod_97(entity[4]) == 1) == (iban == valid)
            seen.add(entity[4])
    assert len(seen) == 600
    text, found = make.replace("from 2001:db8:0:0:1:0:0:ff00 and 12:30:45")
    assert [e[2] for e in found] == ["ip6"] and re.fullmatch("from [0-9a-f]{4}:[0-9a-f]{3}:(?:[0-9a-f]:){5}[0-9a-f]{4} and 12:30:45", text)
