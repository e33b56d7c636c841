"""Text operators against brute force, and on odd tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import decontamination, html_text, language_id, line_dedup, mixing, near_dedup, quality_model, quality_rules, token_output, toxicity
from cellweave.llm.boosting import Trees
from cellweave.llm.common import new_path
from cellweave.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, texts, lang="en", source="s"):
    """Rows of (doc_id, text); extra columns clash with names that operators add."""
    given = [(i, t, lang, source, None if t is None else len(t)) for i, t in texts]
    extra = {c: F.lit("x") for c in ("key", "size", "row", "kept", "_id", "n_words", "score", "band", "class_id", "line_no", "target")}
    return spark.createDataFrame(given, DOCS).withColumns(extra)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, no ids."""
    long = prose(9, 30_000)
    return make(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a b c"), (5, "a b c"), (5, "other text here"), (None, "a b c"), (None, None), (6, "\x00 é   😀")])


def empty(spark):
    return make(spark, [(1, "x")]).filter("1 = 0")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (None, "text here"), (1, "a b c")], "item_id bigint, text string")
    some = labels(spark, [(5, 1, 0), (5, 0, 1), (4, None, None), (None, 1, 1)])
    tok = tokenizer_path()
    for docs, n in ((odd(spark), 10), (empty(spark), 0)):
        assert quality_rules.op1_quality_rules(docs).count() == n
        assert quality_rules.filter_documents(docs).columns == docs.columns
        assert language_id.op2_language_id(spark, docs).count() == n
        assert toxicity.op3_toxicity(spark, docs, some).count() == n
        assert near_dedup.op5_near_dedup(spark, docs).count() == n
        assert near_dedup.deduplicated(docs).columns == docs.columns
        assert quality_model.op6_quality_model(spark, docs, some).count() == n
        assert decontamination.op7_decontamination(spark, docs, bench).count() == n
        assert decontamination.clean(spark, docs, bench).columns == docs.columns
        assert mixing.op8_mixing(docs).count() == n
        assert mixing.mixed(docs).columns == docs.columns
        assert token_output.op9_token_output(spark, docs, tok).count() == n
        assert line_dedup.op10_line_dedup(spark, docs).count() == (6 if n else 0)
        assert line_dedup.deduplicated(docs).columns == docs.columns
    none = labels(spark, []) if False else some.filter("1 = 0")
    assert {r["score"] for r in quality_model.op6_quality_model(spark, odd(spark), none).collect()} == {0.5}
    assert decontamination.op7_decontamination(spark, odd(spark), bench.filter("1 = 0")).filter("contaminated").count() == 0


# ---- 1 ----


def test_rules_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "#", "!", "é", "a b a b "]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.op1_quality_rules(make(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_repeat_words"], r["n_dup_lines"]) == (len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_ablation(spark):
    led = quality_rules.ledger(make(spark, [(1, "a"), (2, prose(1, 50)), (3, "x! " * 30), (4, "#" * 30 + prose(2, 20))]))
    got = {(r["policy"], r["rule"]): (r["rejected_by_policy"], r["rejected_by_rule"], r["only_by_rule"]) for r in quality_rules.ablation(led).collect()}
    assert got["base-1", "too_short"] == (2, 1, 1) and got["web-2", "symbols"][1:] == (1, 1)
    assert quality_rules.filter_documents(make(spark, [(1, "a"), (2, prose(1, 50))]), "base-1").select("doc_id").first()[0] == 2


def test_length_alone_rejects_no_text(spark):
    texts = [prose(4, 500_000), prose(4, 50), " ".join(random.Random(2).choice("abcdefgh") for _ in range(500)), " ".join(random.Random(2).choice(WORDS) for _ in range(20_000))]
    kept = quality_rules.filter_documents(make(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [0, 1]


# ---- 2 ----


def _kneser_ney(words, order=language_id.ORDER):
    """P(symbol | the four before) by the recursive definition, from a list of words."""
    full = Counter()
    for w in words:
        s = language_id.START * (order - 1) + w + language_id.END
        full.update(s[k : k + order] for k in range(len(s) - order + 1))
    levels = {order: full}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    once = {n: sum(v == 1 for v in c.values()) for n, c in levels.items()}
    twice = {n: sum(v == 2 for v in c.values()) for n, c in levels.items()}
    discount = {n: once[n] / (once[n] + 2 * twice[n]) if once[n] and twice[n] else 0.5 for n in levels}

    def p(symbol, before, floor):
        if before is None:
            return floor
        n = len(before) + 1
        own = {g: v for g, v in levels[n].items() if g[:-1] == before}
        below = p(symbol, before[1:] if before else None, floor)
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(before + symbol, discount[n]) - discount[n], 0) / total + discount[n] * len(own) / total * below

    return p, set(levels[1])


def _learnt(spark, by_lang):
    rows = [(" ".join(w), lang) for lang, w in by_lang.items()]
    return language_id.learn(spark.createDataFrame(rows, "text string, lang string"))


BY_LANG = {"x": ["abba", "abc", "cab", "abca", "bacca"] * 3 + ["cc"], "y": ["ddd", "dab"] * 4 + ["bad", "dada"]}


def test_kneser_ney_against_brute_force(spark):
    m, _ = _learnt(spark, BY_LANG)
    exact = {lang: _kneser_ney(w) for lang, w in BY_LANG.items()}
    floor = 1 / (len(set().union(*(symbols for _, symbols in exact.values()))) + 1)
    words = ["abba", "dab", "zebra", "cabd", "é", "dadada", "a"]
    got = m.word_bits(words)
    for k, w in enumerate(words):
        s = language_id.START * 4 + w + language_id.END
        for j, lang in enumerate(m.langs):
            want = -sum(np.log2(exact[lang][0](s[i], s[i - 4 : i], floor)) for i in range(4, len(s)))
            assert got[k, j] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("entries", [language_id.MODEL_ENTRIES, 40, 12, 0])
def test_kneser_ney_sums_to_one(spark, monkeypatch, entries):
    """After each context, whatever the model's bound: the symbols and an unknown one."""
    monkeypatch.setattr(language_id, "MODEL_ENTRIES", entries)
    m, _ = _learnt(spark, BY_LANG)
    symbols = ["a", "b", "c", "d", language_id.END, "z"]
    for prefix in ("", "a", "ab", "dd", "cab", "zz"):
        padded = language_id.START * 4 + prefix
        total = sum(m.symbol_probabilities(padded + s)[-1] for s in symbols)
        # A bound may leave a language without symbols: the floor alone stands for all.
        assert total == pytest.approx(np.ones(2), abs=1e-4) or entries < 40


def test_cut_models_keep_their_probabilities(spark, monkeypatch):
    whole, _ = _learnt(spark, BY_LANG)
    monkeypatch.setattr(language_id, "MODEL_ENTRIES", 30)
    cut, _ = _learnt(spark, BY_LANG)
    for (h, first, lang, gain, _), (h2, first2, lang2, gain2, _) in zip(whole.tables, cut.tables, strict=True):
        known = {(int(x), int(n)): g for x, a, z in zip(h, first, first[1:], strict=False) for n, g in zip(lang[a:z], gain[a:z], strict=True)}
        for x, a, z in zip(h2, first2, first2[1:], strict=False):
            assert all(g in (0, pytest.approx(known[int(x), int(n)])) for n, g in zip(lang2[a:z], gain2[a:z], strict=True))


@pytest.mark.parametrize("entries", [60, 30, 0])
def test_the_bound_of_the_model_changes_no_answer(spark, monkeypatch, entries):
    """What is not sent is looked up: bits, languages and scores are those of the whole model."""
    whole, _ = _learnt(spark, BY_LANG)
    texts = ["abba cab dab", "bad dada ddd bad", "zebra cabd é dadada a", "", "12", "bacca " * 5 + "dadab", "ab bacd abcab ddda", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.createDataFrame([(None, "dad"), (3, "abcc dab")], "doc_id long, text string"))
    want = sorted(map(tuple, language_id.predict(docs, whole).collect()), key=str)
    monkeypatch.setattr(language_id, "MODEL_ENTRIES", entries)
    cut, _ = _learnt(spark, BY_LANG)
    assert sum(len(t[2]) for t in cut.tables) < sum(len(t[2]) for t in whole.tables) and cut.rest is not None
    got = sorted(map(tuple, language_id.predict(docs, cut).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 10
    assert all(g[2:5] == pytest.approx(w[2:5], rel=1e-5, abs=1e-6) for g, w in zip(got, want, strict=True))
    # Words that the sent tables tell in full have their values there.
    words = ["abba", "dab", "zebra", "cabd", "é", "bacca", "a"]
    bits, exact = cut.word_bits(words), whole.word_bits(words)
    told = ~np.isnan(bits[:, 0])
    assert bits[told] == pytest.approx(exact[told], rel=1e-5)


def test_models_do_not_share_what_workers_remember(spark):
    two, _ = _learnt(spark, BY_LANG)
    one, _ = _learnt(spark, {"x": ["dab", "bad"] * 5})
    other, _ = _learnt(spark, {"x": BY_LANG["y"], "y": BY_LANG["x"]})
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["abba cab", "dab ddd", "²½ 12", "①Ⅷ", "12 _", ""])], "doc_id long, text string").coalesce(1)
    want = {"two": ["x", "y"], "one": ["x", "x"], "other": ["y", "x"]}
    for _ in range(4):
        for name, m in (("two", two), ("one", one), ("other", other)):
            got = [r["lang_pred"] for r in language_id.predict(docs, m).orderBy("doc_id").collect()]
            assert got == [*want[name], *["und"] * 4]


def test_curve_is_fitted_on_rows_not_learnt_from(spark):
    rows = spark.createDataFrame([(f"word{k} " + "abc " * (k % 3), "x" if k % 2 else "y") for k in range(60)], "text string, lang string")
    left_out = rows.filter(language_id._held_out("text"))
    counts = {r["gram"]: (r["n"], r["n_learnt"]) for r in language_id.gram_counts(rows).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_learnt").alias("n_learnt")).collect()}
    start = language_id.START * 4 + "w"
    assert counts[start] == (60, 60 - left_out.count()) and 0 < left_out.count() < 30


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "unk", "ach"]}[lang]
        rows.append((i, " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(20)), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.op2_language_id(spark, docs).join(docs, "doc_id")
    assert got.filter("lang <> lang_pred").count() == 0
    for r in got.limit(20).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


# ---- 3 ----


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(3)
    terms = [("idiot", False), ("loser", False), ("scum", False), ("vequ", True), ("trashy", False), ("bomente", True), ("idioten", True), ("lose", True)]
    lex = toxicity.automaton(terms)
    words = ["idiot", "vequ", "vequent", "scu", "scums", "trash", "bomenteado", "bometeado", "xbomente", "bomxntes", "idiotxn", "losern", "bomenbomente"]
    for t, _ in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(1, 2)):
                k = rng.randint(0, len(w) - 1)
                rng.choice([lambda: w.__setitem__(k, rng.choice("abxe")), lambda: w.insert(k, rng.choice("abxe")), lambda: w.pop(k) if len(w) > 2 else None])()  # noqa: B023
            words.append("".join(w))
    for w, got in zip(words, lex.run(words).tolist(), strict=True):
        exact = any(w.startswith(t) if p else w == t for t, p in terms)
        near = any(_distance(w, t) <= 1 for t, p in terms if not p and len(t) >= toxicity.FUZZY_WORD)
        near |= any(_distance(w[:k], t) <= 1 for t, p in terms if p and len(t) >= toxicity.FUZZY_BEGINNING for k in range(len(w) + 1))
        assert got == (toxicity.EXACT if exact else toxicity.FUZZY if near else toxicity.NONE), w


def test_lexicon_asks_for_contexts_of_their_own(spark):
    """Copies of one toxic text give no terms; a small language's terms enter by their own evidence."""
    rng = random.Random(14)
    rows = [(0, prose(k, 30)) for k in range(1500)]
    rows += [(1, "unlucky rareword here " + prose(5000, 25))] * 40
    for k in range(400):
        w = prose(2000 + k, 30).split()
        # "zapfel-" stands in 1 % of the toxic rows only, with an ending of its own each time.
        w.insert(rng.randint(0, 30), f"zapfel{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" if k < 8 else "idiot")
        rows.append((1, " ".join(w)))
    got = toxicity.lexicon(spark.createDataFrame(rows, "y int, text string"))
    assert ("idiot", False) in got and any(p and "zapfel".startswith(t) for t, p in got)
    assert not any(t.startswith(("unlu", "rare")) for t, _ in got)
    lex = toxicity.automaton(got)
    assert lex.run(["zapfelqq", "zpfelqq", "idoit", "idiott"]).tolist() == [toxicity.EXACT, toxicity.FUZZY, toxicity.NONE, toxicity.FUZZY]


def test_repeated_ids_do_not_multiply_rows_to_learn_from(spark):
    docs = make(spark, [(1, f"text {k}") for k in range(50)] + [(2, "b"), (3, None)])
    got = quality_model.labelled(docs, labels(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 1)]), "quality")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([t for i, t in ((1, (1, "text 0")), (2, (0, "b")), (3, (1, None))) if zlib.crc32(str(i).encode()) % 5], key=str)


def test_quotation():
    t = 'they said "you idiot" once. You idiot!'
    at = [m.span() for m in re.finditer("idiot", t)]
    assert [toxicity.quoted(t, *a) for a in at] == [True, False]


def test_toxic_documents(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(300):
        w = prose(i, 30).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randint(0, 29), rng.choice(["loser", "idiot"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    docs = make(spark, [*rows, (900, prose(1, 10) + " loserr"), (901, None)])
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, docs, labels(spark, marks)).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in marks)
    assert got[900]["score"] > got[901]["score"] and got[901]["predicted"] == 0


# ---- 4 ----


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>a  b</p><p>c", "a b\nc"), ("<article><h1>T</h1><p>x &amp; y<footer>f</footer></article><p>out", "T\nx & y"),
        ("<nav>n</nav><main><p>m<script>if (a<b) '</p>'</script> n</p></main><div class='comments'>c</div>", "m n"),
        ("<!-- x --><style>p{}</style><p>k<form>f</form><p>l", "k\nl"), ("<p>a<b>b</b>c<br>d</p>", "abc d"), ("<", "<"), ("<p", ""), ("<p>&lt;p&gt; &#233;", "<p> é"),
        ("<article><p>a</p><div class='ad-box'>buy</div><p>b</p></article>", "a\nb"), ("<div class='has-sidebar'><p>kept text</p></div>", "kept text"),
    ],
)
def test_extract(page, text):
    assert html_text.extract(page) == text


def _between(weights, window, share, most):
    """The same search, by looking at each window anew."""
    n = len(weights)
    total = lambda i: sum(weights[max(0, i) : max(0, i + window)])
    threshold = max(1, min(most, int(max((total(i) for i in range(1 - window, n)), default=0) * share)))
    runs, own = [], []
    for i in range(n):
        if weights[i]:
            if own and i - own[-1] > window:
                runs.append(own)
                own = []
            own.append(i)
    keep = set()
    for run in [*runs, own] if own else runs:
        if max(total(k - j) for k in run for j in range(window)) >= threshold:
            keep.update(range(run[0], run[-1] + 1))
    return [i in keep for i in range(n)]


def test_windows_against_brute_force():
    rng = random.Random(15)
    for _ in range(3000):
        w = [rng.choice([0, 0, 0, 3, 20, 90]) for _ in range(rng.randint(0, 30))]
        window, share, most = rng.randint(1, 4), rng.choice([0.1, 0.2, 0.9]), rng.choice([1, 40, 80])
        assert html_text.between(w, window, share, most) == _between(w, window, share, most), w


def test_made_articles():
    """Articles of short and long blocks, with what surrounds them, marked or not."""
    rng = random.Random(16)
    for k in range(60):
        blocks = [prose(k, 3), *[prose(100 * k + j, rng.choice([1, 8, 40])) for j in range(rng.randint(2, 9))], prose(7000 + k, 40)]
        menu = "".join(f"<li><a href=/x>{prose(j, 1)}</a></li>" for j in range(rng.randint(4, 12)))
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        marked = body.replace("</p>", "</p><aside>buy</aside><div class='ad-box'><p>a</p><p>b</p><p>c</p></div>", 1)
        for page in (f"<nav><ul>{menu}</ul></nav><article>{marked}</article><div class=comments><p>{prose(1, 50)}</p></div>", f"<ul>{menu}</ul><div>{body}</div><ul>{menu}</ul>"):
            assert html_text.extract(page) == "\n".join(blocks)


def test_time_is_linear_in_the_page():
    parts = ['<a ">" ', '<a "', "<a '\">", '<div class="', "<body>", "<!--", "<p><a>", "&amp", "<div class=x ", "<aaaa", "<script>"]
    for part in parts:
        began = time.perf_counter()
        html_text.extract(part * 60_000)
        html_text.extract(part * 60_000 + ">")
        assert time.perf_counter() - began < 4, part


def test_distribution_without_an_article():
    page = "".join(f"<li><a href=x>link {k}</a></li>" for k in range(30)) + "".join(f"<p>{prose(k, 30)}</p>" for k in range(5)) + "<p>short</p>" + f"<p>{prose(9, 30)}</p>" + "".join(f"<li><a>more {k}</a></li>" for k in range(30))
    got = html_text.extract(page).split("\n")
    assert len(got) == 7 and "short" in got


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", "<p>é😀</p>"), (None, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    assert sorted(map(tuple, html_text.op4_html_text(p).collect()), key=str) == [(1, "u", "é😀", 2), (None, None, "", 0)]


# ---- 5 ----


def _shingles(t):
    w = re.findall(r"[0-9a-z]+", t.lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def _jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = prose(g, 120).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 10)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randint(0, len(w) - 1)] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [prose(1000 + k, 60) for k in range(40)] + [texts[0], texts[0].upper(), "one two", "one two"]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op5_near_dedup(spark, make(spark, list(enumerate(texts)))).collect()}
    sets = [_shingles(t) for t in texts]
    parent = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(sets[i], sets[j]) >= 0.8]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    found = sum(got[i] == got[j] for i, j in pairs)
    assert found >= 0.99 * len(pairs)
    # No class joins texts that plain counts hold far apart.
    for i in range(len(texts)):
        own = [j for j in got if got[j] == got[i] and j != i]
        assert not own or max(_jaccard(sets[i], sets[j]) for j in own) >= 0.7
        assert got[i] == min([i, *own])


def test_every_link_of_a_bucket_is_found(spark):
    """Buckets of dozens of groups around one text: each has a copy that the text's own
    group takes, and one that is near this copy only."""
    rng, base, texts = random.Random(13), prose(3, 400).split(), [prose(3, 400)]
    edited = lambda w, at: " ".join(f"new{rng.randint(0, 10**9)}" if k in at else x for k, x in enumerate(w))
    for _ in range(60):
        spots = rng.sample(range(0, 400, 10), 11)
        texts.append(edited(base, spots[:3]))
        texts.append(edited(texts[-1].split(), spots[3:]))
    texts += [f"{texts[0]} tail{k}" for k in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op5_near_dedup(spark, make(spark, list(enumerate(texts)))).collect()}
    sets = [_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if _jaccard(sets[i], sets[j]) >= 0.8]
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []


def _roots(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("copies", "words", "edits"), [(600, 400, 14), (1200, 200, 6), (5000, 80, 3)])
def test_large_groups_against_brute_force(spark, copies, words, edits):
    """All pairs of a group of edited copies: as many classes as the exact links make."""
    rng = random.Random(copies)
    base = prose(77, words).split()
    texts = [" ".join(base)]
    for _ in range(copies - 1):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randint(0, words - 1)] = f"new{rng.randint(0, 10**9)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op5_near_dedup(spark, make(spark, list(enumerate(texts)))).collect()}
    numbers: dict = {}
    grams = [[numbers.setdefault((g, k), len(numbers)) for g, n in _shingles(t).items() for k in range(n)] for t in texts]
    uses = Counter(x for own in grams for x in own)
    shared = {x: k for k, x in enumerate(x for x, n in uses.items() if n > 1)}
    m = np.zeros((copies, len(shared)), np.float32)
    for i, own in enumerate(grams):
        m[i, [shared[x] for x in own if x in shared]] = 1
    both, size = m @ m.T, np.array([len(x) for x in grams])
    close = both / (size[:, None] + size - both) >= 0.8
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True) if i > j]
    want = _roots(copies, pairs)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9999 * len(pairs)
    assert len(set(got.values())) <= len(set(want))


def test_one_of_each_class_stays(spark):
    a, b = prose(1, 50), prose(2, 50)
    got = near_dedup.deduplicated(make(spark, [(3, a), (2, a), (2, a), (7, b), (None, b), (8, a + " more")]))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7]


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    agree, want = [], []
    for _ in range(40):
        ids = np.sort(rng.choice(2**50, 60, replace=False).astype(np.uint64))
        x, y = ids[:50], ids[10:]
        wx = rng.random(50) * 3 + 0.1
        wy = np.concatenate((wx[10:], rng.random(10)))
        both = np.minimum(wx[10:], wy[:40]).sum()
        want.append(both / (wx.sum() + wy.sum() - both))
        k = [near_dedup.band_keys(i, w, np.zeros(len(i), np.int64), 1)[0] for i, w in ((x, wx), (y, wy))]
        agree.append((k[0] == k[1]).mean())
    assert np.mean(agree) == pytest.approx(np.mean(np.array(want) ** near_dedup.ROWS), abs=0.08)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101)]
    e = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["key"][0]: r["root"][0] for r in near_dedup.components(e).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


# ---- 6 ----


def test_statistics_by_hand():
    got = dict(zip(quality_model.FEATURES, quality_model.statistics("Ab ab ab. x|y\n\nAb ab #1\nAb ab #1\n"), strict=True))
    want = {
        "log_chars": np.log1p(33), "log_words": np.log1p(10), "word_chars": 22 / 10, "long_words": 0, "symbols": 2 / 33, "pipes": 1 / 10, "exclaims": 0,
        "upper": 3 / 33, "digits": 2 / 33, "stops": 1 / 10, "not_ascii": 0, "distinct_words": 5 / 10, "top_word": 3 / 10, "same_as_before": 0,
        "distinct_pairs": 6 / 10, "log_lines": np.log1p(3), "line_words": 10 / 3, "dup_lines": 1 / 3, "line_ends": 0, "blanks": 7 / 33,
    }
    assert got == pytest.approx(want)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = Trees().fit(x[:1500], y[:1500])
    p = t.predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95 and ((p >= 0) & (p <= 1)).all()

    def walk(row):
        score = t.base
        for k in range(t.n_trees):
            node = 0
            for _ in range(t.depth):
                node = 2 * node + (2 if row[t.feature[k, node]] > t.cut[k, node] else 1)
            score += t.leaf[k, node - (2**t.depth - 1)]
        return 1 / (1 + np.exp(-score))

    assert p[:20] == pytest.approx([walk(r) for r in x[1500:1520]])


def test_quality_is_learnt(spark):
    rows = [(i, prose(i, 40) if i % 3 else "### " * 40 + prose(i, 5)) for i in range(300)]
    got = {r["doc_id"]: r["predicted"] for r in quality_model.op6_quality_model(spark, make(spark, rows), labels(spark, [(i, int(i % 3 > 0), 0) for i in range(300)])).collect()}
    assert sum(got[i] == int(i % 3 > 0) for i in range(300)) >= 298


# ---- 7 ----


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["a", "b", "c", "é", "x1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "B "]) for _ in range(n))
    items = [(k, prose(50 + k, 25)) for k in range(6)] + [(10, "A b"), (11, "c"), (12, None), (13, text(30)), (13, "x1 x1 x1")]
    docs = []
    for k in range(50):
        parts = [text(rng.randint(0, 20))]
        if k % 3 == 0:
            w = items[k % 6][1].split()
            s = rng.randint(0, 12)
            parts.append(" ".join(w[s : s + rng.randint(5, 13)]))
        docs.append((k, " ".join([*parts, text(rng.randint(0, 9))])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.op7_decontamination(spark, make(spark, docs), bench).collect()}

    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])].add(i)
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names |= own
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """With two bits of hash, and a pass for each item or two: the results do not change."""
    rng = random.Random(17)
    docs = make(spark, [(k, " ".join(rng.choice("abcdef") for _ in range(60))) for k in range(30)])
    bench = spark.createDataFrame([(k, " ".join(rng.choice("abcdef") for _ in range(n))) for k, n in enumerate([3, 4, 5, 3, 12, 2])], "item_id bigint, text string")
    want = sorted(map(tuple, decontamination.op7_decontamination(spark, docs, bench).collect()))
    spans = decontamination.word_spans
    row, query = decontamination._index_row, decontamination.Queries.__init__

    def coarse(texts):
        hashes, *rest = spans(texts)
        return hashes & np.uint64(3), *rest

    items = [(k, " ".join("abcdef"[(k + j) % 6] for j in range(3))) for k in range(4)]
    texts = [b"a b c d e f a b c", b"f e d"]
    monkeypatch.setattr(decontamination, "word_spans", coarse)
    block = decontamination.Block({**row([1, 2], texts)})
    found = sorted((int(w), int(p)) for ws, ps in block.matches(decontamination.Queries(items)) for w, p in zip(ws, ps, strict=True))
    assert found == [(0, 0), (0, 6), (1, 1), (2, 2), (3, 3)]
    monkeypatch.undo()
    monkeypatch.setattr(decontamination, "QUERY_WORDS", 4)
    assert sorted(map(tuple, decontamination.op7_decontamination(spark, docs, bench).collect())) == want and query


def test_proximity_and_query_blocks(spark, monkeypatch):
    docs = make(spark, [(1, "the quick brown fox jumps over the very lazy dog today ok"), (2, "nothing here")])
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog today ok"), (2, "nothing")], "item_id bigint, text string")
    path = new_path(spark, "t")
    decontamination.build_index(docs, path)
    monkeypatch.setattr(decontamination, "QUERY_WORDS", 5)
    assert {r["item_id"] for r in decontamination.matches(spark, path, bench).collect()} == {"2"}
    assert {(r["doc_id"], r["item_id"], r["doc_pos"]) for r in decontamination.matches(spark, path, bench, slop=1).collect()} >= {(1, "1", 1), (2, "2", 0)}


# ---- 8 ----


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    monkeypatch.setattr(mixing, "SLICES", 8)
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(0, 30)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.op8_mixing(docs).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    by = defaultdict(int)
    for i, _, _, s, _ in rows:
        by[s] += size[i]
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    left, fixed = dict(weight), {}
    budget = 1.5 * sum(by.values())
    while left:  # share, stop at twice the source, share the excess again
        rest = budget - sum(fixed.values())
        over = [s for s in left if rest * weight[s] / sum(left.values()) > 2 * by[s]]
        if not over:
            fixed |= {s: rest * weight[s] / sum(left.values()) for s in left}
            break
        for s in over:
            fixed[s] = 2.0 * by[s]
            del left[s]
    source = {i: s for i, _, _, s, _ in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and r["target"] == pytest.approx(fixed[s])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - fixed[s]) <= 31 for s in fixed) and sum(taken.values()) <= budget + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op8_mixing(docs.repartition(5)).collect()))
    assert mixing.mixed(docs).count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_rows_without_id_are_spread(spark):
    docs = make(spark, [(None, prose(k, 10)) for k in range(300)])
    got = mixing.mix(docs).groupBy("copies").count().collect()
    assert {r["copies"]: r["count"] for r in got} == {1: 150, 2: 150}
    key = mixing.shuffle_key(F.col("doc_id"), F.col("text"))
    assert docs.select(key).distinct().count() == 300


# ---- 9 ----


@pytest.mark.parametrize("width", [1, 7, 15, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2 ** min(width, 31), 1000).astype("<u4")
    p = token_output.pack(ids, width)
    assert len(p) == (1000 * width + 7) // 8
    assert (token_output.unpack(p, width, 0, 1000) == ids).all() and (token_output.unpack(p, width, 321, 55) == ids[321:376]).all()


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    enc = token_output.Encoder(tokenizer_path())
    assert enc.cuts
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", " a", " the,", " é.", "'s", "1", "日本", "\x1c", "\x85", "​", "　", "😀", "<|endoftext|>", "word", ".", ",", "!!"]
    texts = ["".join(rng.choice(bits[:15]) if k % 2 else rng.choice(bits) for _ in range(rng.randint(0, 25))) for k in range(4000)]
    whole = [np.array(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for k in range(0, 4000, 100) for x in enc.batch(pa.array(texts[k : k + 100]))] == whole


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 50)
    enc = token_output.Encoder(tokenizer_path())
    rows = [(i, prose(i, i % 40)) for i in range(60)]
    random.Random(1).shuffle(rows)
    path = new_path(spark, "t")
    token_output.write(make(spark, rows), path, tokenizer_path())
    ids = {i: [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    start = 0
    got = {r["doc_id"]: r for r in token_output.documents(spark, path).collect()}
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids[i]))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        start += len(ids[i])
    assert token_output.ids_of(spark, path, [3, 59, 999]) == {3: ids[3], 59: ids[59]}


# ---- 10 ----


def _near(v, w):
    """By the module's definition, from the words of two different lines."""
    a, b = " ".join(v), " ".join(w)
    if max(len(v), len(w)) >= 10 and abs(len(v) - len(w)) <= 1 and _distance(v, w) == 1:
        return True
    return min(len(v), len(w)) < 10 and max(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 1 and _distance(a, b) == 1


def _edited(rng, w):
    """A few ways to change a line a little: words, or one character."""
    w, kind = list(w), rng.randint(0, 7)
    k = rng.randint(0, len(w) - 1)
    if kind == 1:
        w[k] = rng.choice(["zz", w[0]])
    elif kind == 2:
        w.insert(k, "yy")
    elif kind == 3 and len(w) > 1:
        w.pop(k)
    elif kind >= 4:
        s = " ".join(w)
        k = rng.randint(0, len(s) - 1)
        s = (s[:k] + rng.choice("é q") + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + s[k + 1 :])[kind % 3]
        w = s.split() or ["x"]
    return w


def test_lines_against_brute_force(spark):
    rng = random.Random(10)
    base = [prose(k, 1 + k % 20).split() for k in range(40)]
    docs = []
    for i in range(150):
        lines = [rng.choice([" ", ""]) + " ".join(_edited(rng, rng.choice(base))) for _ in range(rng.randint(1, 5))]
        docs.append((rng.choice([i, i, i // 7, None]), "\n".join([*lines, "", "short one"])))
    docs += [docs[3], (900, "one two three four five six seven eight nine"), (901, "one two three four five six seven eight nines")]
    found = line_dedup.decisions(make(spark, docs)).collect()
    hashes = dict(map(tuple, make(spark, docs).select("text", F.xxhash64("text")).collect()))
    got = {(r["doc_id"], r["text_hash"], r["line_no"]): r for r in found}
    last = line_dedup.LAST
    all_lines = [((last if i is None else i, hashes[t], n), x.split()) for i, t in docs for n, x in enumerate(t.split("\n")) if x.split()]
    assert len(found) == len(all_lines)
    for place, w in all_lines:
        first = min(p for p, v in all_lines if v == w)
        near = [p for p, v in all_lines if v != w and _near(v, w)]
        keep = min([first, *near])
        r = got[None if place[0] == last else place[0], place[1], place[2]]
        want = (None if keep[0] == last else keep[0], keep[2], keep == place, 0 if keep == first else 1)
        assert (r["keep_doc_id"], r["keep_line_no"], r["kept"], r["distance"]) == want
    whole = Counter(map(tuple, line_dedup.deduplicated(make(spark, docs)).select("doc_id", "text").collect()))
    want = Counter((i, "\n".join(x for n, x in enumerate(t.split("\n")) if not x.split() or got[i, hashes[t], n]["kept"])) for i, t in docs)
    assert whole == want
    assert not got[901, hashes[docs[-1][1]], 0]["kept"]


def test_rows_of_one_id_keep_their_own_lines(spark):
    docs = make(spark, [(1, "common line here"), (5, "common line here\nA two"), (5, "unique B one\nB two"), (None, "A two\nC"), (None, "unique B one\nD")])
    got = Counter(map(tuple, line_dedup.deduplicated(docs).select("doc_id", "text").collect()))
    assert got == Counter([(1, "common line here"), (5, "A two"), (5, "unique B one\nB two"), (None, "C"), (None, "D")])


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [(k, prose(k, 40)) for k in range(30)]
    rows = [*clean, (40, clean[3][1]), (41, clean[4][1] + " end"), (42, "short"), (43, "### $$$ " * 30), (44, prose(99, 20) + " " + prose(500, 15))]
    make(spark, rows).select(DOCS.split(",")[0].split()[0], "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(500, 15))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
    assert kept["quality_rules"] == [*range(30), 40, 41, 44]
    assert kept["near_dedup"] == [*range(30), 44]
    assert kept["decontamination"] == [*range(30)]
    assert Counter(kept["mixing"]) == Counter(kept["token_output"]) and max(Counter(kept["mixing"]).values()) <= 2
    assert sum(Counter(kept["mixing"]).values()) * 40 == pytest.approx(1.5 * 30 * 40, abs=40)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["token_output"])


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd(spark).unionByName(make(spark, [(k, prose(k, 60)) for k in range(20, 30)]))), ("empty", empty(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out, store = corpus_pipeline.build(spark, str(tmp_path / name))
        rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in out.collect())
        assert bool(rows) == (name == "odd")
        # The store stays and holds what the rows say, also after another run.
        corpus_pipeline.run(spark, str(tmp_path / name))
        assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_output.documents(spark, store).collect()) == rows


def test_stages_of_two_pipelines_do_not_disturb_each_other(spark, tmp_path):
    import corpus_pipeline

    make(spark, [(k, prose(k % 15, 40)) for k in range(40)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(3, 12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    held = []
    for _ in range(2):
        x = docs
        for _, stage in corpus_pipeline.STAGES[1:3]:
            x = stage(spark, x, str(tmp_path))
        held.append(x)
    assert [sorted(r["doc_id"] for r in x.collect()) for x in held] == [[k for k in range(15) if k != 3]] * 2
