"""Merkle manifests, conversation repair and WARC archives against plain versions, and on rows that are easy to get wrong."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from oracle import connect, difference

from lumbre.llm import merkle, places, repair, warc
from lumbre.llm.common import shared_path
from lumbre.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_van_emde_boas_order(levels):
    places_of = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places_of).tolist()) == list(range(merkle.tree_size(levels)))
    assert places_of[0].tolist() == [0]
    # Every lower half is one run of neighbouring places.
    top = levels // 2
    for root in range(8**top if top else 0):
        inside = np.concatenate([places_of[d][root * 8 ** (d - top) : (root + 1) * 8 ** (d - top)] for d in range(top, levels)])
        assert inside.max() - inside.min() + 1 == len(inside) == merkle.tree_size(levels - top)


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append((level[start:i], level[i + 1 : start + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    def leaf(r, lower):
        text = r[1].translate({c: c + 32 for c in range(65, 91)}) if lower and r[1] is not None else r[1]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0], leaf(r, False)) if r[0] is not None else (False, 0, leaf(r, False)))
        trees[lang] = (members, plain_tree([leaf(r, False) for r in members]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = plain_tree([trees[n][1][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        members, levels = trees[name]
        for i, r in enumerate(members):
            proof = plain_proof(levels, i) + plain_proof(top, place)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf(r, hit)
            for left, right in proof:
                digest = sha("".join(left) + digest + "".join(right))
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in proof)), digest, digest == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, id long, leaf string, `index` int, root string, path string, _index long"


def manifest_rows(rng, sizes):
    rows = []
    for lang, size in sizes.items():
        for _ in range(size):
            text = rng.choice([None, "", "abc", "ABC def", "Straße É 🙂", "x" * 3000 + "Y"])
            rows.append((rng.randrange(10**6), text, lang, rng.choice([None, "", "src", "Q"]), rng.choice([None, 0, 17])))
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1300, "": 1, None: 9, "é": 8, "z": 513, "a": 65}, {"en": 1}, {}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_equals_plain_trees(spark, sizes):
    rows = manifest_rows(random.Random(5), sizes)
    if "en" in sizes and len(rows) > 5:
        # Repeated rows, and ids that repeat with another text.
        rows += [rows[0], rows[0], (rows[1][0], "other", "en", None, 3), (None, "no id", "en", None, None), (None, "no id", "en", None, None)]
    df = spark.createDataFrame([(*r, "t", 1, "l", 2, "r", "p", 3) for r in rows], SCHEMA).repartition(5)
    got = merkle.prove(merkle.documents_manifest(df))
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_manifest(rows)


def test_three_bands_of_blocks(spark, monkeypatch):
    """Small blocks, so that trees go over several bands."""
    rows = manifest_rows(random.Random(6), {"en": 700, "de": 70, "fr": 8})
    df = spark.createDataFrame([(*r, "t", 1, "l", 2, "r", "p", 3) for r in rows], SCHEMA)
    built = merkle.documents_manifest(df)
    assert len(built.groups) == 2 and built.groups[0].filter("count > 512").count() == 2
    block = built.groups[0].filter("count > 512 AND block = 0").first()
    # Siblings through the addresses equal siblings of the plain tree.
    texts = merkle.level_texts(block["nodes"], merkle.block_shape(0, block["count"]))
    assert len(texts) == 4 and all(texts[d][i] == sha("".join(texts[d + 1][8 * i : 8 * i + 8])) for d in range(3) for i in range(len(texts[d])))


def test_places_follow_the_order_in_hot_and_small_groups(spark):
    rows = [("hot", k % 50, k) for k in range(3000)] + [(f"g{k % 40}", k, k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, row int").repartition(7)
    got = places.numbered(df, "g", ["v", "row"]).collect()
    want = {}
    for g, v, r in sorted(rows):
        want.setdefault(g, []).append(r)
    assert all(want[x.g][x._index] == x.row and x._count == len(want[x.g]) for x in got) and len(got) == len(rows)


# -- 12 ---------------------------------------------------------------------------------------------------------------


def plain_repair(pattern):
    """Least (cost, letters) over rows of (initial, fault), by strings and tuples."""
    moves = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    best = {0: (0, "")}
    for initial, fault in pattern:
        after = {}

        def offer(state, value):
            if state not in after or value < after[state]:
                after[state] = value

        for state, (cost, letters) in best.items():
            offer(state, (cost + 3, letters + "D"))
            if fault in "bd":
                continue
            extra = int(fault == "t")
            for inserted, (at, c, w) in enumerate([(state, cost, letters), (moves[state][1], cost + 2, letters + "I")]):
                wanted, following = moves[at]
                if initial == wanted:
                    offer(following, (c + extra, w + "K"))
                if initial == "s" and at == 0:
                    offer(1, (c + extra, w + "K"))
                offer(following, (c + 2 + extra, w + "R"))
        best = after
    tails = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    return min((c + tails[s][0], w + tails[s][1]) for s, (c, w) in best.items())


def every_edit(pattern):
    """All edit strings of short patterns, with any insertions up to two in a row."""
    found = []

    def go(i, cost, letters, roles):
        if i == len(pattern):
            for tail in ("", "u", "a", "ua", "au"):
                final = roles + tail
                body = final[1:] if final[:1] == "s" else final
                if (final == "" or body) and body == "ua" * (len(body) // 2):
                    found.append((cost + 2 * len(tail), letters + "I" * len(tail)))
            return
        initial, fault = pattern[i]
        for ins in ("", "u", "a", "ua", "au"):
            base = (cost + 2 * len(ins), letters + "I" * len(ins), roles + ins)
            go(i + 1, base[0] + 3, base[1] + "D", base[2])
            if fault not in "bd":
                extra = int(fault == "t")
                go(i + 1, base[0] + extra, base[1] + "K", base[2] + initial)
                for role in "ua":
                    go(i + 1, base[0] + 2 + extra, base[1] + "R", base[2] + role)

    go(0, 0, "", "")
    return min(found)


def blockwise(pattern, size):
    blocks = []
    for b in range(0, len(pattern), size):
        text = "".join(i + f for i, f in pattern[b : b + size])
        blocks.append([(entry, *p) for entry in ((0,) if b == 0 else range(4)) for p in repair.block_paths(text, entry)])
    cost, path, tail = repair.join_blocks(blocks)
    return cost, "".join(letters for _, letters in path) + tail


def test_plain_repair_equals_all_edits():
    for n in (1, 2, 3):
        for pattern in itertools.product(itertools.product("suao", "-bt"), repeat=n):
            if n < 3 or random.Random(str(pattern)).random() < 0.03:
                assert plain_repair(pattern) == every_edit(pattern), pattern


@pytest.mark.parametrize("size", [1, 3, 32])
def test_blocks_give_the_least_integer_path(size):
    rng = random.Random(size)
    for n in [1, 2, 5, 8, 40, 100]:
        for _ in range(30 if n < 40 else 3):
            pattern = [(rng.choice("suuaaao"), rng.choice("----tbd")) for _ in range(n)]
            assert blockwise(pattern, size) == plain_repair(pattern), pattern


def plain_conversations(rows):
    out, every = {}, {}
    for conv, turn, role, text in rows:
        every.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        every[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    space = "\x20\t\n\x0b\x0c\r"
    for conv, members in every.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha(r[2])))
        seen, pattern = set(), []
        for _, role, text in members:
            bare = [c for c in text if c not in space]
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
            seen.add((role, text))
            pattern.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault))
        cost, audit = plain_repair(pattern)
        lines, state, i = [], 0, 0
        for letter in audit:
            wanted, following = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[state]
            if letter == "I":
                lines.append(f"{wanted}:")
                state = following
                continue
            _, role, text = members[i]
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = 1 if pattern[i][0] == "s" else following
            elif letter == "R":
                lines.append(f"{wanted}:{text}")
                state = following
            i += 1
        turns = [t for t, _, _ in members if t is not None]
        initials = [r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in members]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for _, f in pattern) for k in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)),
        )
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, place long, block int, pattern string, audit string, `key` string, kind int"


def conversation_rows():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "Fine.", "Fine", "Ends here! ", "é?\x0b", "…", "no end 🙂", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    # A long conversation over several blocks, ties of turns, null turns and ids, repeated rows, a very long text.
    rows += [(900, t // 2, rng.choice(roles[:5]), rng.choice(texts)) for t in range(150)]
    rows += [(901, None, "user", "Q?"), (901, 1, "user", "Q?"), (901, 1, "user", "Q?"), (901, 1, "assistant", "A."), (None, None, None, None), (None, 3, "user", "Hi."), (902, 5, "assistant", "word " * 50_000)]
    return rows


def test_conversations_equal_a_plain_repair(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, 2, "p", "a", "k", 3) for r in rows], CONVERSATIONS).repartition(6)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_damaged(df).collect()}
    assert got == plain_conversations(rows)


def test_repaired_rows_carry_texts_and_edits(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (1, 3, "user", "Hi"), (2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    placed = repair.placed_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    edits = repair.choose_edits(repair.with_faults(placed))
    audits = {r.key: (r.cost, r.audit, r.illegal) for r in edits.collect()}
    assert audits == {"=1": (*plain_repair([("s", "-"), ("a", "-"), ("u", "t"), ("u", "d")]), 2), "=2": (0, "KK", 0)}
    got = sorted([(r.key, r.place, r.before, r.edit, r.role, r.text) for r in repair.repaired_rows(placed, edits).collect()], key=str)
    assert [r for r in got if r[0] == "=2"] == [("=2", 0, None, "K", "user", "Q?"), ("=2", 1, None, "K", "assistant", "A.")]
    # One letter for each row and for each empty turn.
    assert sorted(audits["=1"][1]) == sorted([r[3] for r in got if r[0] == "=1"] + ["I" for r in got if r[0] == "=1" and r[2]])


def test_no_conversations(spark):
    assert repair.repair_damaged(spark.createDataFrame([], CONVERSATIONS)).collect() == []


# -- 13 ---------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, bytes long, digest string, equal string, file string, `range` long, value string, record string, salt int"
EXTRA = ("p", 1, "d", "e", "f", 2, "v", "r", 3)


def record(payload):
    """A whole record, as a page may quote one."""
    body = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n{payload}"
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def page_rows():
    big, quoted = "<p>é🙂 " * 400, record("inner") * 3 + "WARC/1.1\r\n" * 5 + record("x" * 2000)
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (9, None, big), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", quoted), (8, "u", quoted), (None, "n", big), (None, "n", "tiny")]
    rows += [(10, "u", "WARC/1.1\r\n"), (11, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\nContent-Length: 99999999999999999999\r\n\r\n"), (12, "u", "tail\r\n\r\n"), (13, "u", "\r\n"), (14, "u", "y" * 300_000 + record("z") + "y" * 300_000)]
    rows += [(100 + k, f"http://site/{k}", f"page {k} " * (k % 90) + (record(f"q{k}") if k % 5 == 0 else "")) for k in range(300)]
    return rows


def plain_pages(rows):
    heads = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            heads[data] = max(heads.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        head = heads.get(data)
        revisit = head is not None and head != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["1k", "20k", "128m"])
def test_archives_give_back_every_page(spark, split):
    """Records that span many byte ranges, payloads that quote records, and magic at every kind of place."""
    rows = page_rows()
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], PAGES).repartition(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        path = shared_path(spark, "archives")
        warc.write_archives(df, path)
        got = warc.read_archives(spark, path)
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == plain_pages(rows)
        assert got.filter("NOT intact").count() == 0 and warc.chain_ends(spark, path).filter("NOT complete").count() == 0
        payloads = {(r.page_id, bytes(r.payload)) for r in got.filter("record_type = 'response'").collect()}
        assert payloads == {(i, (h or "").encode()) for (i, _, h), p in [(r, plain_pages([r])) for r in rows]} - {(i, h.encode()) for i, _, h in rows if h and len(h.encode()) >= 1000 and (i, len(h.encode())) not in {(a, b) for a, b, _, t, _ in plain_pages(rows) if t == "response"}}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_broken_link_ends_the_chain(spark, tmp_path):
    whole = record("one") + record("two") + record("three")
    (tmp_path / "good.warc").write_text(whole, newline="")
    (tmp_path / "bad.warc").write_text(record("one") + record("two").replace("Content-Length: ", "Content-Length: 1", 1) + record("three"), newline="")
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((os.path.basename(r.file), bytes(r.payload)) for r in got if r.file.endswith("good.warc")) == [("good.warc", b"one"), ("good.warc", b"three"), ("good.warc", b"two")]
    assert b"three" not in {bytes(r.payload) for r in got if r.file.endswith("bad.warc")}
    ends = {os.path.basename(r.file): r.complete for r in warc.chain_ends(spark, f"file://{tmp_path}").collect()}
    assert ends == {"good.warc": True, "bad.warc": False}


def test_revisits_of_a_hot_payload_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "broadcast_if_small", lambda df: df)
    rows = [(k, "u", "h" * 1000) for k in range(200)] + [(500, "v", "other" * 300)]
    got = warc.with_roles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(k, 199) for k in range(199)} | {(199, None), (500, None)}


def test_no_pages(spark):
    path = shared_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0 and warc.chain_ends(spark, path).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair", "op13_warc_archives"])
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR)) is None
