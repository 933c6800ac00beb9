"""Operators for training data against plain versions, and on rows that are easy to get wrong."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, difference

from lumbre.llm import bloom_dedup, cotraining, curriculum, lattice, lattice_lm, main_text, minhash, nbest, notices, prefix_targets, quality_rules
from lumbre.llm.common import tokenizer_path
from lumbre.llm.components import components
from lumbre.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
#: Columns with names that operators use themselves.
CLASHING = "kept boolean, size long, node long, component long, digest long, word string, block long, score double, positions string, _t string, _row string"
CLASHING += ", _words string, _pairs string, _lines string, _text string, l_digest string, l_id string, r_digest string, r_id string, _lang string, _length string, _text_view string, _lid string"
EXTRA = (True, 1, 2, 3, 4, "w", 5, 0.5, "p", "t", "r", *"abcdefghijkl")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))


def hard_rows():
    same = "One two three four five six seven eight nine ten, under the MIT License."
    near = " ".join(f"word{k}" for k in range(60))
    return [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n\x0b ", None, None), (3, same, "en", "a"), (4, same, "en", "b"), (4, same, "en", "b"), (5, same.replace(" ", "  \n"), None, "a"),
        (6, near, "de", None), (7, near + " end", "de", "b"), (8, near.upper(), "de", "b"), (None, "no id here", "fr", "a"), (None, same, "fr", "c"), (9, LONG, "en", "a"), (10, "ñandú 🙂 straße ▁ mark\x00", "es", "c"), (11, "x", "es", "c"),
    ]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in hard_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR)) is None


# -- 1 ----------------------------------------------------------------------------------------------------------------


def all_ways(v, word, logs):
    """Log of the sum over all segmentations, by plain recursion."""
    if not word:
        return 0.0
    terms = []
    for k in range(1, len(word) + 1):
        if word[:k] in v.normal:
            terms.append(logs[v.normal[word[:k]]] + all_ways(v, word[k:], logs))
        elif k == 1:
            terms.append(sum(logs[v.byte_ids[b]] for b in word[0].encode()) + all_ways(v, word[1:], logs))
    return float(np.logaddexp.reduce(terms))


def test_lattice_sums_all_segmentations():
    v = lattice.pieces(tokenizer_path())
    random_ = np.random.default_rng(3)
    logs = np.log(random_.dirichlet(np.ones(v.size)))
    logs = np.append(logs, lattice.NEVER)
    words = ["▁the", "▁thing", "▁tionre", "▁é🙂", "▁", "▁ñandú", "▁aaaa", "▁\x00b"]
    got = lattice.log_likelihoods(v, words, logs[:, None])[:, 0]
    assert got == pytest.approx([all_ways(v, w, logs) for w in words], rel=1e-9)


def test_expected_counts_are_the_slopes_of_the_likelihood():
    v = lattice.pieces(tokenizer_path())
    logs = np.append(np.log(v.prior() + 1e-12), lattice.NEVER)
    words = ["▁thering", "▁ß🙂"]
    counts = np.array([2.0, 1.0])
    got = lattice.expected_counts(v, words, logs, counts)
    for piece in [v.normal["ing"], v.normal["▁the"], v.normal["er"], v.byte_ids[0xF0]]:
        up = logs.copy()
        up[piece] += 1e-5
        slope = sum(c * (a - b) for c, a, b in zip(counts, lattice.log_likelihoods(v, words, up[:, None])[:, 0], lattice.log_likelihoods(v, words, logs[:, None])[:, 0])) / 1e-5
        assert got[piece] == pytest.approx(slope, abs=1e-3)


def check_base(rows, scored):
    words = [(i, brute.WORD.findall(brute.lower(t))) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter()
    for i, w in words:
        if not held(i):
            train.update(w)
            train[None] += 1
    total, distinct = sum(train.values()), len(train)
    want = sorted((str(i), held(i), len(w) + 1, sum(train[x] > 0 for x in [*w, None]), total, round(sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in [*w, None]), 4)) for i, w in words)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored)
    assert got == want


def test_language_model_on_documents(spark, documents):
    scored = QUERIES["op1_lattice_lm"](spark, SF_DIR).collect()
    check_base([(r.doc_id, r.text) for r in documents], scored)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    # Words of other languages and nonsense are less likely than training text.
    trained = [r for r in scored if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_language_model_on_hard_rows(spark, hard):
    check_base([r[:2] for r in hard_rows()], lattice_lm.lattice_scores(hard, rounds=1).collect())
    empty = lattice_lm.lattice_scores(hard.filter("false"), rounds=1)
    assert empty.count() == 0


def test_weights_are_fitted_in_three_rounds(spark, hard, monkeypatch):
    rounds, expect = [], lattice_lm._expect
    monkeypatch.setattr(lattice_lm, "_expect", lambda *a: (rounds.append(1), expect(*a))[1])
    got = sorted((str(r.doc_id), r.score) for r in lattice_lm.lattice_scores(hard).collect())
    assert len(rounds) == 3
    want = sorted((str(r.doc_id), r.score) for r in lattice_lm.lattice_scores(hard, rounds=3).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


# -- 2 ----------------------------------------------------------------------------------------------------------------


def base_rules(text):
    text = text or ""
    words = brute.WORD.findall(text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality_rules_on_hard_rows(spark, hard):
    got = quality_rules.line_frequency_verdicts(hard, host_col="source").collect()
    want = sorted((str(i), *base_rules(t)) for i, t, *_ in hard_rows())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert quality_rules.line_frequency_verdicts(hard.filter("false"), host_col="source").count() == 0


def test_lines_above_the_limit_deplete(spark):
    menu = "Home and away and many more words that stand on every page of this host, again and again, to the very end of it all"
    own = [" ".join(f"own{k}x{j}" for j in range(40)) for k in range(12)]
    rows = [(k, f"{menu}\n{own[k] if k < 6 else f'short {k}'}", "h") for k in range(12)] + [(20, menu, "other"), (21, menu, None), (22, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r.doc_id: r for r in quality_rules.line_frequency_verdicts(docs).collect()}
    assert [got[k].kept for k in range(12)] == [True] * 6 + [False] * 6
    assert got[0].removed_chars == 0 and got[1].removed_chars == len(menu.replace(" ", ""))
    assert got[20].kept and got[21].kept and not got[22].kept
    clean = {r.doc_id: r.clean_text for r in quality_rules.remove_frequent_lines(docs).collect()}
    assert clean[0] == rows[0][1] and clean[1] == own[1] and clean[20] == menu


# -- 3 ----------------------------------------------------------------------------------------------------------------


def test_exact_notices(spark, hard):
    got = {str(r.doc_id): r for r in notices.scan_notices(hard).collect()}
    assert (got["3"].n_base, got["3"].first_word, got["3"].base_labels, got["3"].labels, got["3"].score) == (1, 10, "mit", "mit", 1.0)
    assert (got["0"].n_words, got["0"].n_base, got["0"].first_word, got["0"].labels, got["0"].score) == (0, 0, None, "", 0.0)
    assert notices.scan_notices(hard.filter("false")).count() == 0
    for i, t, *_ in hard_rows():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t))
        if i not in (None, 4):
            assert got[str(i)].n_words == len(words)


def test_seeds_lose_no_match():
    """Searching around seeds finds what the expression finds on the whole text."""
    rng = random.Random(2)
    made = [notices.notice(p, x) for p, x in notices.BASE_NOTICES + notices.MORE_NOTICES]
    for _ in range(400):
        one = rng.choice(made)
        letters = list(one.phrase)
        for _ in range(rng.randint(0, one.errors + 1)):
            k, kind = rng.randrange(len(letters)), rng.random()
            if kind < 0.3:
                letters[k] = rng.choice("abc ")
            elif kind < 0.6:
                letters.insert(k, rng.choice("abc "))
            else:
                del letters[k]
        data = notices.normalised_words("ab the " + "".join(letters) + " zz é mit license")
        for n in made:
            assert bool(n.pattern.search(data.decode())) == bool(notices.find_fuzzy(data, n))


def test_letters_beyond_ascii_are_errors_within_the_limit():
    mit = notices.notice("under the mit license", "mit")
    for text in ("under the mit licénse", "under the mít license", "under the mit li\u0441ense", "under the mit lic🙂ense", "under the mit licemse"):
        assert [e for e, _ in notices.find_fuzzy(notices.normalised_words(f"ab {text} zz"), mit).values()] == [1], text
    for text in ("under the mit lic3nse", "ünder the mit licénse"):
        assert not notices.find_fuzzy(notices.normalised_words(f"ab {text} zz"), mit), text
    rng = random.Random(5)
    made = [notices.notice(p, x) for p, x in notices.BASE_NOTICES + notices.MORE_NOTICES]
    for _ in range(400):
        one = rng.choice(made)
        letters = list(one.phrase)
        for _ in range(rng.randint(0, one.errors + 1)):
            k = rng.randrange(len(letters))
            letters[k : k + rng.randint(0, 1)] = rng.choice("é🙂\u0441a ")
        data = notices.normalised_words("éß the " + "".join(letters) + " zz é mit license")
        for n in made:
            assert bool(n.pattern.search(data.decode())) == bool(notices.find_fuzzy(data, n))


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_prefix_targets_on_hard_turns(spark):
    rows = [
        (1, 0, "user", "hi [x] ~1 <b>", 1), (1, 1, "assistant", "</s>[INST] ok [/INST]", 2), (1, 2, "user", None, 3), (1, 3, "assistant", "", 4), (1, 4, "user", "bye", 5),
        (2, None, None, "~0~3", 6), (2, 0, "assistant", "a~]b", 7), (2, 0, "assistant", "a~]b", 8), (None, 0, "system", "only", 9), (3, 0, "user]", "q", 9),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t long")
    formatted = prefix_targets.format_conversations(turns)
    got = {r.conv_id: r for r in prefix_targets.digests(formatted).collect()}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])), key=lambda r: r[0]):
        each = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for r, t in each if r == "assistant")
        assert got[conv].n_turns == len(each)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in each).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = prefix_targets.expand(formatted).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example) for r in made] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert made[0].prompt == "[user]hi ~1x~2 ~01 ~3b></s>[assistant]" and made[0].completion == "~3/s>~1INST~2 ok ~1/INST~2"
    assert prefix_targets.digests(prefix_targets.format_conversations(turns.filter("false"))).count() == 0


def test_digests_come_from_expanded_examples(spark, monkeypatch):
    calls, expand = [], prefix_targets.expand
    monkeypatch.setattr(prefix_targets, "expand", lambda *a, **k: (calls.append(1), expand(*a, **k))[1])
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "~0"), (1, 2, "user", "r"), (1, 3, "assistant", "é"), (1, 4, "user", "tail"), (2, 0, "user", "none"), (None, 0, "assistant", "")]
    formatted = prefix_targets.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in prefix_targets.digests(formatted).collect()}
    assert calls
    made = expand(formatted).collect()
    for k, turns, n, loss in ((1, 5, 2, 3), (2, 1, 0, 0), (None, 1, 1, 0)):
        chars = sum(len(r.prompt) + len(r.completion) + len("</s>") for r in made if r.conv_id == k)
        assert (got[k].n_turns, got[k].n_examples, got[k].loss_chars, got[k].formatted_chars) == (turns, n, loss, chars)


# -- 5 ----------------------------------------------------------------------------------------------------------------


def test_mix_reaches_targets(spark):
    plan = curriculum.schedule_documents(spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "source AS key", "1 AS rank"), source_col="source").toPandas()
    total = plan["size"].sum()
    by = plan.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert by["target"].sum() == pytest.approx(1.5 * total)
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all() and (plan["taken"] <= 2 * plan["size"]).all()
    assert all(0 <= p <= 1 for ps in plan["positions"] for p in ps)


def test_schedule_times(spark):
    """The inverse of the integral of a weight that moves from start to end."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(u / 10, a, b) for u in range(11) for a, b in [(1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0)]], "u double, a double, b double")
    for r in frame.withColumn("t", curriculum.time_of(F.col("u"), F.col("a"), F.col("b"))).collect():
        assert (r.a * r.t + (r.b - r.a) * r.t * r.t / 2) / ((r.a + r.b) / 2) == pytest.approx(r.u, abs=1e-12)


def test_mix_on_hard_rows(spark, hard):
    plan = curriculum.schedule_documents(hard).collect()
    assert len(plan) == len(hard_rows())
    assert sum(r["size"] for r in plan) == sum(len(brute.WORD.findall(t or "")) for _, t, *_ in hard_rows())
    mixed = curriculum.mixed_documents(hard)
    assert mixed.columns == hard.columns
    assert mixed.count() == sum(len(r.positions) for r in plan)
    assert curriculum.schedule_documents(hard.filter("false")).count() == 0 and curriculum.mixed_documents(hard.filter("false")).count() == 0


def test_running_sums_over_buckets(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = sorted(map(str, curriculum.schedule_documents(docs).collect()))
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 7)
    assert sorted(map(str, curriculum.schedule_documents(docs).collect())) == whole


# -- 6 ----------------------------------------------------------------------------------------------------------------


def test_main_text_cases(spark):
    costs, other = {"p": 0.05, "div": 1.0, "li": 1.0, "a": 1.0, "h1": 0.05, "nav": 1.0, "article": 1.0, "b": 0.05, "br": 0.05}, 0.5
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>
      <div class="cookie-notice">We use cookies on this site and all over the place today</div><article><h1>Head &amp; tail</h1><p>One   two<br>three&nbsp;four <b>bold</b> word<p>Five six &lt;seven&gt;
      <div class="ad">Buy now or else you will be sorry for ever</div><p>Last <!-- hidden --> words.</article><div id="comments"><p>Nice one said a reader of the page</p></div><footer>End</footer>"""
    assert main_text.main_text(page, costs, other) == "Head & tail\nOne two three four bold word\nFive six <seven>\nLast words."
    for odd in (None, "", "<", "<p", "<!-- open", "<script>never closed", "<div><nav></div>", "&", "<>", "<a href='>x"):
        assert isinstance(main_text.main_text(odd, costs, other), str)
    assert main_text.main_text("just words", {}, 1.0) == "just words"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = main_text.extract_main_text(pages).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 4 and got[0].text
    assert main_text.extract_main_text(pages.filter("false")).count() == 0


def test_main_text_of_labelled_pages(spark):
    """Held against the marked content of the given pages."""
    import html

    def marked(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        inner = re.sub("</?(?:b|a)(?: [^>]*)?>", "", inner.replace("<br>", " "))
        parts = (main_text.SPACE.sub(" ", html.unescape(x)).strip(" ") for x in re.split("<[^>]*>", inner))
        return "\n".join(x for x in parts if x)

    got = {r.page_id: r.text for r in QUERIES["op6_html_main_text"](spark, SF_DIR).collect()}
    want = {r.page_id: marked(r.html) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_best_region_is_the_best(spark):
    rng = random.Random(5)
    for _ in range(200):
        page = [("x", "", False, False) if rng.random() < 0.5 else ("", "w " * rng.randint(1, 3), rng.random() < 0.3, False) for _ in range(rng.randint(0, 14))]
        values = [-0.01 * (1 if t else len(x.split())) if a else -1.5 if t else len(x.split()) for t, x, a, _ in page]
        a, b = main_text.best_region(page, {"x": 1.5}, 1.0)
        assert sum(values[a:b]) == pytest.approx(max([0, *(sum(values[i:j]) for i in range(len(page)) for j in range(i + 1, len(page) + 1))]))


# -- 7 ----------------------------------------------------------------------------------------------------------------


def test_classifier_on_labels_it_did_not_see(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unseen = labels.filter("doc_id % 3 = 0")
    scored = cotraining.classify(docs, labels.filter("doc_id % 3 <> 0")).join(unseen, "doc_id").select("quality_kept", "quality").collect()
    assert len(scored) > 100 and sum(r.quality_kept == bool(r.quality) for r in scored) >= 0.97 * len(scored)


def test_classifier_on_hard_rows(spark, hard):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (4, 1), (None, 1), (6, None)], "doc_id long, quality int")
    got = cotraining.classify(hard, labels)
    assert set(hard.columns) <= set(got.columns) and got.count() == len(hard_rows())
    assert {r.quality_score for r in got.select("quality_score").collect()} == {0.8}
    assert cotraining.classify(hard, labels.filter("false")).select("quality_score").first()[0] == 0.5
    trained = {"models": {"_text_view": ([0.1] * 13, 0.2), "_field_view": ([0.1] * 24, 0.1)}, "calibrated": {v: ([1.0], 0.0) for v in ("_text_view", "_field_view")}, "combined": ([1.0, 1.0], 0.0)}
    scored = cotraining.score_documents(hard, trained).collect()
    assert len(scored) == len(hard_rows()) and all(0 <= r.quality_score <= 1 for r in scored)
    # Columns with the names of the operator come through as they were.
    assert {tuple(r[c] for c in ("_t", "_words", "_text_view", "_lid", "_lang")) for r in scored} == {("t", "a", "k", "l", "i")}
    assert cotraining.score_documents(hard.filter("false"), trained).count() == 0


# -- 8 ----------------------------------------------------------------------------------------------------------------


def best_ways(v, text, n):
    """N best over the lattice of the whole text, by lists of the n best to every position."""
    marked = "".join("▁" if c == " " else "\0" if c == "▁" else c for c in " " + text)
    ways = [[0.0]] + [[] for _ in marked]
    for j in range(1, len(marked) + 1):
        found = []
        for i in range(max(0, j - 16), j):
            piece = v.starts.get(marked[i:j], -1)
            if piece >= 0:
                found += [s + v.score[piece] for s in ways[i]]
            elif j == i + 1:
                found += [s + v.spelled for s in ways[i]]
        ways[j] = sorted(found, reverse=True)[:n]
    return ways[-1]


def test_n_best_equals_a_search_of_the_whole_text():
    v, rng = nbest.vocabulary(tokenizer_path()), random.Random(1)
    texts = ["", "Hello world", "  a\n\nthe €uro🙂 x\tyz", "▁mark inside ▁▁", "thntblere of the inreertily bleores"]
    texts += ["".join(rng.choice("the inga\n▁éﷺ ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    lists, every = nbest.segment(tokenizer_path(), pa.array(texts), 4)
    for text, best, ways in zip(texts, lists.to_pylist(), every):
        assert [s for s, _ in ways] == best_ways(v, text, 4)
        seen = set()
        for _, changes in ways:
            ids = list(best)
            for c in sorted(changes, key=lambda c: -c["at"]):
                ids[c["at"] : c["at"] + c["drop"]] = c["ids"]
            assert b"".join(v.bytes_of[i] for i in ids).decode()[1:] == text
            seen.add(tuple(ids))
        assert len(seen) == len(ways)


def test_encoding_round_trip_on_hard_rows(spark, hard):
    encoded = nbest.encode_n_best(hard, n=3)
    rows = nbest.decode(encoded).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, t or "") for i, t, *_ in hard_rows())
    assert set(hard.columns) <= set(encoded.columns)
    assert all(len(r.n_best) <= 3 and [w.score for w in r.n_best] == sorted((w.score for w in r.n_best), reverse=True) for r in rows)
    both = nbest.encode_n_best(hard, n=3, decoded=True)
    assert Counter((r.doc_id, r.decoded) for r in both.collect()) == Counter((r.doc_id, r.decoded) for r in rows) and both.columns == [*encoded.columns, "decoded"]
    assert nbest.decode(nbest.encode_n_best(hard.filter("false"))).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, documents, words):
    rows = [(r.doc_id, r.text) for r in documents]
    edited = [(1000 + i, " ".join(w for k, w in enumerate((t or "").split(" ")) if k % 97 != 3)) for i, t in rows if i % 3 == 0]
    chain = " ".join(f"c{k}" for k in range(200))
    steps = [(2000 + k, " ".join(f"d{j}" for j in range(k * 8)) + " " + " ".join(chain.split(" ")[k * 8 :])) for k in range(12)]
    everything = rows + edited + steps
    docs = spark.createDataFrame(everything, "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=words).collect()
    want = brute.near_components(everything, words, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute.shingles(dict(everything)[r.doc_id], words)) for r in got)


def test_near_duplicates_on_hard_rows(spark, hard):
    got = minhash.near_duplicates(hard, words=4).collect()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.component_id)
    assert len(got) == len(hard_rows()) and sum(r.kept for r in got) == 3 + 1 + 1 + 1 + 3
    assert of[3] == of[4] == of[5] == {3} and of[6] == of[7] == of[8] == {6} and of[0] == {0} and of[2] == {2} and 3 in of[None]
    stay = minhash.drop_near_copies(hard, words=4)
    assert stay.columns == hard.columns and stay.count() == sum(r.kept for r in got)
    assert minhash.near_duplicates(hard.filter("false")).count() == 0 and minhash.drop_near_copies(hard.filter("false")).count() == 0


def test_parity_bits_bound_the_similarity():
    rng = np.random.default_rng(1)
    for size, change in [(50, 5), (500, 60), (3000, 900)]:
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[change:], rng.integers(0, 2**63, change).astype(np.uint64)])
        bits = [np.bincount((x % np.uint64(minhash.PARITY_BITS)).astype(int), minlength=minhash.PARITY_BITS) & 1 for x in (a, b)]
        assert (bits[0] ^ bits[1]).sum() <= 2 * change


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits_per_row", [1, 16])
def test_exact_dedup_on_hard_rows(spark, hard, bits_per_row):
    got = bloom_dedup.exact_dedup(hard, bits_per_row=bits_per_row).collect()
    groups = defaultdict(list)
    for i, t, *_ in hard_rows():
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = bloom_dedup.drop_exact_copies(hard, bits_per_row=bits_per_row)
    assert stay.columns == hard.columns and stay.count() == len(groups)
    assert bloom_dedup.exact_dedup(hard.filter("false")).count() == 0 and bloom_dedup.drop_exact_copies(hard.filter("false")).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    columns = docs.columns
    good = stages["quality classifier"](spark, docs, sf_dir)
    assert good.columns == columns
    single = stages["exact dedup"](spark, docs, sf_dir).collect()
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in docs.collect()]
    assert len(single) == len(set(texts)) and list(single[0].asDict()) == columns
    near = stages["MinHash near-dedup"](spark, docs, sf_dir)
    roots = brute.near_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert near.columns == columns and {r.doc_id for r in near.collect()} == set(roots.values())
    mixed = stages["mixing sources to target weights"](spark, docs, sf_dir)
    plan = curriculum.schedule_documents(docs).collect()
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: len(r.positions) for r in plan if r.positions})
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(columns) < set(out.columns) and out.count() > 0
