import functools
import gzip
import json
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clarispark.llm import chat, decontamination, html_layout, packing, quality, toxicity, warc
from clarispark.llm.common import labelled_sample


# --- Packing ---


def test_encoder_equals_tokenizer():
    e = packing.encoder(packing.default_tokenizer())
    texts = ["", "  ", "Hello, WORLD's end", "İstanbul ΣΑΣ <|endoftext|>x 'Sx don't ²³½ a\x1cb 東京 é ́x 12 a_b --''s", "a" * 3000, "été\nnaïve x"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packings_hold_every_piece():
    rng = random.Random(0)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        p = packing.best_fit({}, counts, 100)
        pool = [p, packing.mutate(p, counts, 100, rng)]
        for _ in range(4):
            pool.append(packing.crossover(rng.choice(pool), rng.choice(pool), counts, 100, rng))
            pool.append(packing.mutate(pool[-1], counts, 100, rng))
        for x in pool:
            assert packing._demand(x) == counts and all(packing.fill(q) <= 100 for q in x)
            assert packing.bins(x) >= packing.lower_bound(counts, 100)
            assert packing._load(packing._dump(x)) == x


def exact_bins(counts, capacity):
    """Fewest bins, by trying all patterns in turn (small counts)."""
    lengths = sorted(counts, reverse=True)

    @functools.cache
    def fewest(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)
        best = sum(left)
        def fill(i, room, now):
            nonlocal best
            if i == len(lengths):
                best = min(best, 1 + fewest(tuple(now)))
                return
            for k in range(min(now[i], room // lengths[i]), -1, -1):
                now[i] -= k
                fill(i + 1, room - k * lengths[i], now)
                now[i] += k
        now = list(left)
        now[first] -= 1
        fill(first, capacity - lengths[first], now)
        return best

    return fewest(tuple(counts[n] for n in lengths))


def test_islands_find_the_fewest_bins(spark):
    rng = random.Random(2)
    for _ in range(3):
        counts = {}
        for _ in range(7):
            n = rng.randint(15, 70)
            counts[n] = counts.get(n, 0) + 1
        found = packing.pack_counts(spark, counts, 100, islands=2, epochs=2, generations=20)
        assert packing._demand(found) == counts and packing.bins(found) == exact_bins(counts, 100)


def test_islands_beat_best_fit_decreasing():
    """Bins of three pieces that fill them exactly, where best-fit needs more; islands without Spark, as they migrate."""
    rng = random.Random(5)
    counts = {}
    for _ in range(20):
        a, b = rng.randint(380, 490), rng.randint(250, 280)
        for n in (a, b, 1000 - a - b):
            counts[n] = counts.get(n, 0) + 1
    plain = packing.bins(packing.best_fit({}, counts, 1000))
    homes = [[] for _ in range(3)]
    for epoch in range(6):
        homes = [packing.evolve(i, epoch, counts, 1000, x, 60, 8, 20) for i, x in enumerate(homes)]
        homes = [[homes[i - 1][0], *x[1:]] for i, x in enumerate(homes)]
    best = min((packing._load(x[0]) for x in homes), key=packing.bins)
    assert packing._demand(best) == counts and packing.bins(best) < plain


def test_pack(spark):
    rows = [(1, "hello world " * 2000), (2, None), (3, ""), (4, "some words here"), (4, "some words here"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1))
    got = packing.pack(docs).collect()
    e = packing.encoder(packing.default_tokenizer())
    want = sorted((str(d), k, zlib.crc32(x[s : s + 8192])) for d, t in rows for x in [e([t or ""])[0] + b"\0\0\0\0"] for k, s in enumerate(range(0, len(x), 8192)))
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


# --- Chat ---

_CHARS = st.lists(st.sampled_from([*"<>[]/\\ \nsab", "INST", "SYS", "ROLE", "TURN", "[INST]", "</s>", "<<SYS>>"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), _CHARS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    out = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert chat.read_back(out) == turns


def test_events_fold(spark):
    e = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "he"), (1, 2, "delta", 1, None, "llo"), (1, 3, "message", 2, "user", "again"), (1, 4, "regenerate", 1, "assistant", "yo"),
         (1, 5, "edit", 0, None, "hey"), (1, 6, "message", 3, "user", None), (2, 0, "message", 0, "user", "gone"), (2, 1, "delete", 0, None, None), (None, 0, "message", 0, None, "n")]
    events = spark.createDataFrame(e, chat.EVENTS_SQL).repartition(3)
    rows = chat.format_events(events).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).extend(chat.read_back(r["output"]))
    assert by == {1: [("user", "hey"), ("assistant", "yo"), ("user", "")], None: [("", "n")]}
    assert sum(r["last"] for r in rows) == 2
    digests = {r["conv_id"]: r for r in chat.digest_turns(chat.format_events(events)).collect()}
    assert digests[1]["n_turns"] == 3 and digests[1]["loss_chars"] == 2
    assert chat.digest_turns(chat.format_events(events.limit(0))).count() == 0


def _folded(events):
    """Final turns of one conversation, by a plain list."""
    turns = []  # [message, role, text]
    for kind, message, role, text in events:
        at = next((i for i, t in enumerate(turns) if t[0] == message), None)
        if kind == "delete":
            turns = [t for t in turns if t[0] != message]
        elif kind == "regenerate":
            turns = (turns if at is None else turns[:at]) + [[message, role or "", text or ""]]
        elif at is None:
            turns.append([message, role or "", text or ""])
        elif kind == "delta":
            turns[at][2] += text or ""
        elif kind == "edit":
            turns[at][2] = text or ""
        else:
            turns[at][1:] = [role or "", text or ""]
    return [(r, t) for _, r, t in turns]


def test_folds_equal_a_plain_list(spark):
    rng = random.Random(11)
    logs = {c: [(rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", "delete"]), rng.randrange(6), rng.choice(["user", "assistant", None]), rng.choice(["a", "</s>", None, "b" * 50])) for _ in range(rng.randrange(1, 40))] for c in range(60)}
    rows = [(c, i, k, m, r, t) for c, log in logs.items() for i, (k, m, r, t) in enumerate(log)]
    rng.shuffle(rows)
    by = {}
    for r in sorted(chat.format_events(spark.createDataFrame(rows, chat.EVENTS_SQL).repartition(5)).collect(), key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).extend(chat.read_back(r["output"]))
    assert by == {c: want for c, log in logs.items() if (want := _folded(log))}


def test_logs_of_conversations_fold_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "long text é " * 4000), (1, 2, "assistant", "x" * 100_001), (1, 3, "user", None), (1, 3, "user", None), (1, 4, None, "n"), (2, 0, "assistant", "abc"), (None, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("nth", "opened", "touched", "seq", "kind", "message")})
    events = chat.events_of(table)
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    by = {}
    for r in sorted(chat.format_events(events).collect(), key=lambda r: r["turn"]):
        by.setdefault(r["conv_id"], []).extend(chat.read_back(r["output"]))
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    assert by == want


# --- Quality and toxicity ---


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice(["ta", "ri", "mo", "se", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic, good = i % 3 == 0, i % 4 != 1
        if toxic:
            words[rng.randrange(60)] = rng.choice(["idiot", "scumbag", "stupid"])
        rows.append((i, " ".join(words) if good else " ".join(w + "$$$" for w in words), int(good), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").withColumn("label", F.lit("x"))
    return docs, spark.createDataFrame([(i, g, x) for i, _, g, x in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, labelled, module, label):
    docs, labels = labelled
    model = module.fit(spark, docs, labels)
    got = module.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    assert sum(r["predicted"] == r[label] for r in held) / len(held) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "w" * 100_000)], "doc_id long, text string").withColumn("score", F.lit(0))
    out = module.score(odd, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    none = module.fit(spark, docs, labels.limit(0))
    assert module.score(docs, none).count() == 600


def test_pairwise_fit_equals_plain_descent():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=120) > 0).astype(int)
    model = quality.fit_pairs(x, y, pairs=400, l2=1e-2)
    again = np.random.default_rng(0)  # the same pairs, in plain loops
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    pairs = list(zip(again.choice(good, 400), again.choice(bad, 400), strict=True))
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        grad = 1e-2 * w
        for d in (np.array([z[i] - z[j] for i, j in pairs]),):
            grad = grad - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w = w - 0.5 * grad
    assert np.allclose(model.weights, w, atol=1e-3)
    raw = model.raw(x)
    assert abs((raw < model.cut).mean() - (y == 0).mean()) < 0.01 and np.allclose(model.score(x) >= model.threshold, raw >= model.cut)


def test_leaks_in_very_long_texts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, "filler " * 200_000 + passage + " tail" * 50_000), (2, "filler " * 100_000)], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    for bound in (decontamination.BROADCAST_SEEDS, 0):
        assert [(r["doc_id"], r["coverage"]) for r in decontamination.find_leaks(docs, items, broadcast_seeds=bound).collect()] == [(1, 1.0)]


def test_samples_leave_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = labelled_sample(spark, docs, labels, "toxic", 50).collect()
    assert len(got) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in got)


def test_gaps_keep_insults_apart_from_clean_words(spark, labelled):
    model = toxicity.fit(spark, *labelled)
    m = dict(zip(w := ["idiot", "idiiot", "id-iot", "stupiid", "tarimo", "moselu"], model.margins(w), strict=True))
    assert min(m["idiot"], m["idiiot"], m["id-iot"], m["stupiid"]) > max(m["tarimo"], m["moselu"])
    assert toxicity.Scorer(model)(["ta ri i d i o t mo"])[0] > 0.5
    assert toxicity.reject_toxic(labelled[0], model).count() < 450


def test_exact_margin_equals_plain_kernel_sum(spark, labelled):
    model = toxicity.fit(spark, *labelled)
    size = model._letters.size
    for word in ("idiot", "scumbagg", "stupid"):
        codes, lengths = model._letters.codes([word])
        c = codes[0, : lengths[0]].tolist()
        phi = {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    f = (c[i] * size + c[j]) * size + c[k]
                    phi[f] = phi.get(f, 0) + toxicity.GAP ** (k - i + 1)
        want = sum(v * model.weights[f] for f, v in phi.items()) / np.sqrt(sum(v * v for v in phi.values())) + model.bias
        assert model.margins([word])[0] == pytest.approx(want, abs=1e-4)


# --- Decontamination ---


def slow_tiles(item, doc, least):
    """Greedy string tiling without hashes."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while p + n < len(item) and t + n < len(doc) and free_i[p + n] and free_d[t + n] and item[p + n] == doc[t + n]:
                    n += 1
                if (n, -p, -t) > (best[0], -best[1], -best[2]):
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return out
        for k in range(n):
            free_i[p + k] = free_d[t + k] = False
        out += n


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, doc = rng.integers(1, 4, rng.integers(1, 14)), rng.integers(1, 4, rng.integers(0, 20))
        got = decontamination.tiles(item, doc, 2)
        assert all((item[p : p + n] == doc[t : t + n]).all() for p, t, n in got)
        assert sum(n for *_, n in got) == slow_tiles(item.tolist(), doc.tolist(), min(2, len(item)))


def test_leaks(spark):
    passage = "alpha beta gamma delta epsilon zeta. eta theta iota kappa lambda mu nu. xi omicron pi rho sigma tau"
    moved = "words before xi omicron pi rho sigma tau and eta theta iota kappa lambda mu nu then Alpha, beta gamma delta epsilon zeta after"
    docs = spark.createDataFrame([(1, moved), (2, "alpha beta gamma delta epsilon alone"), (3, None), (4, ""), (5, "tiny item"), (5, "tiny item"), (None, passage), (7, "clean words only")], "doc_id long, text string")
    docs = docs.withColumns({"item_id": F.lit(1), "coverage": F.lit(2)})
    items = spark.createDataFrame([(10, passage), (11, "tiny item"), (12, None), (13, "")], "item_id long, text string")
    for bound in (10**6, 1):
        got = decontamination.find_leaks(docs, items, broadcast_seeds=bound).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("1", 10), ("5", 11), ("5", 11), ("None", 10)]
        assert {r["doc_id"] for r in decontamination.reject_leaked(docs, items, broadcast_seeds=bound).collect()} == {2, 3, 4, 7}
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), items).count() == 0


# --- HTML ---


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("a  b\n c", "a b c"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z", "- x\n- y\n  1. 1\n  2. 2\n\nz"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td colspan=2>long cell here<tr><td>a<td>b</table>", "long cell here\na  b"),
    ("<p hidden>no</p><p style='display: none'>no</p><script>no</script><style>.x{display:none}</style><b class=x>no</b>yes", "yes"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;x&gt; &amp;amp;", "<x> &amp;"),
    ("<details><summary>s</summary>body</details>", "s"), ("<title>t</title><body>x<!-- c --><textarea>y</textarea>", "xy"), ("<p>a<b>b<br><p>c", "ab\n\nc"), ("x < y <3", "x < y <3"),
])
def test_layout(page, want):
    assert html_layout.extract(page) == want


@given(st.lists(st.sampled_from([*"<>/ab \n&;\"'=", "<p>", "</p>", "<table>", "<td>", "<tr>", "</table>", "<li>", "<ul>", "</ul>", "<!--", "-->", "<script>"]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_layout_takes_anything(page):
    assert isinstance(html_layout.extract(page), str)


def test_deep_pages(spark):
    assert html_layout.extract("<div>" * 20_000 + "x") == "x"
    pages = spark.createDataFrame([(1, None), (1, "<p>a"), (None, "b")], "page_id long, html string").withColumn("text", F.lit(1))
    assert sorted(r["text"] for r in html_layout.extract_pages(pages).collect()) == ["", "a", "b"]


@pytest.mark.parametrize(("page", "want"), [
    ("<ol start='--5'><li>a</ol><table><td colspan='²'>x<td>y</table>", "1. a\n\nx  y"), ("<ol start=' 7x'><li>a<li>b</ol>", "7. a\n8. b"), ("<ol start=-2><li>a", "-2. a"), (f"<ol start={'9' * 5000}><li>a", "1. a"),
    (f"&#{'1' * 5000};&#00000065;&#x0000000042;", "\ufffdAB"), ("a<b x='cut off", "a"), ("<p title='x>y' class=a>Hi</p>", "Hi"), ("<table><tr><td>" + "w" * 300 + "<td>q<tr><td>a<td>b</table>", "w" * 300 + "  q\na" + " " * 161 + "b"),
])
def test_odd_numbers_and_attributes(page, want):
    assert html_layout.extract(page) == want


@pytest.mark.parametrize("page", ["<a x " * 200_000, "<a x='\"> " * 50_000, "<div>" * 200_000 + "x", "<table>" + "<tr>" + "<td colspan=1000>a" * 20_000, "<a" + " =" * 200_000, "<style>" + "{" * 200_000, "<table><tr>" + "<td>wide cell of text" * 999 + "<tr><td><td>x" * 30_000])
def test_long_pages_take_linear_time_and_space(page):
    began = time.process_time()
    assert len(html_layout.extract(page)) < 64 * len(page)
    assert time.process_time() - began < 30


class _Words(HTMLParser):
    """The visible words of a page, by another parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


@given(st.lists(st.sampled_from(["<p>one two</p>", "<div>three &amp; four</div>", "<ul><li>five<li>six</ul>", "<table><tr><td>seven<td>eight</table>", "<script>no</script>", "<style>p{color:red}</style>", "<b>nine</b> ", " ten &lt;x&gt; ", "<template>no</template>", "<h1 title='a>b'>eleven</h1>"]), max_size=12).map("".join))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_another_parser(page):
    other = _Words()
    other.feed(page)
    other.close()
    assert html_layout.extract(page).replace("- ", "").split() == other.words


# --- WARC ---


def _record(block, length=None, kind="response"):
    lines = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{len(block)}>\r\n" + ("" if length is None else f"Content-Length: {length}\r\n")
    return lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_records_that_are_cut_off_or_hold_others():
    inner = b"HTTP/1.1 200 OK\r\n\r\n" + _record(b"inner", 5)
    last = _record(b"last", 4)
    blocks = lambda data: [b for _, b in warc.parse_records(data)]
    assert blocks(_record(inner, len(inner)) + last) == [inner, b"last"]
    assert blocks(_record(b"no length") + last) == [b"no length", b"last"]
    assert blocks(_record(b"short", 9_000) + _record(b"x", 1) + last) == [b"short\r\n", b"x", b"last"]
    assert blocks(_record(b"odd", "many") + last) == [b"odd", b"last"] and blocks(last[:-6]) == [b"la"] and blocks(b"") == [] and blocks(b"no records") == []
    assert blocks(_record(b"huge", 10**12) + last) == [b"huge\r\n", b"last"]
    assert blocks(b"WARC/1.1\r\nWARC-Type: response") == [b""]


def test_warc_files_are_read_by_record(spark, tmp_path):
    rng = random.Random(4)
    pages = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<head><title>n{i}<p>{'é ' * rng.randint(0, 3000)}" .encode() for i in range(300)]
    data = b"".join(_record(x, len(x)) if i % 7 else _record(x) for i, x in enumerate(pages)) + _record(b"meta", 4, "metadata") + _record(b"cut", 900)[:-9]
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(_record(x, len(x))) for x in pages[:50]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
        got = warc.read_responses(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(bytes(r["block"]) for r in got) == sorted([*pages, *pages[:50], b"cut"[:-5] or b""])


def test_payloads_are_decoded():
    page = "<p>é one".encode()
    raw = gzip.compress(page)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(raw[i : i + 7]), raw[i : i + 7]) for i in range(0, len(raw), 7)) + b"0\r\n\r\n"
    for head, body, want in ((b"Content-Encoding: gzip", raw, "é one"), (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked, "é one"), (b"Content-Encoding: gzip", b"plain", "plain"), (b"Content-Type: text/plain", page, "<p>é one"), (b"Content-Type: text/html; charset=latin-1", "<p>é".encode("latin-1"), "é"), (b"Content-Type: text/html; charset=hex", b"<p>a", "a"), (b"X: y", b"<head><title>t</title>no end<p>b", "no end\n\nb")):
        assert warc.derive("i", None, None, b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body, None)[1][-1] == want



def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<title>T &amp; U</title><p>One<p>Two <a href='/x'>l</a>"), (2, None, None), (3, "http://é", "plain \r\n\r\n WARC/1.1 text"), (3, "http://é", "plain \r\n\r\n WARC/1.1 text")], "page_id long, url string, html string")
    responses = warc.responses_of(pages.withColumn("record_id", F.lit("clash")))
    out = warc.derivatives(responses).collect()
    assert len(out) == 8
    ids = {r["page_id"]: r["record_id"] for r in responses.collect()}
    pairs = {}
    for r in out:
        assert r["refers_to"] == ids[r["page_id"]] and r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        pairs.setdefault(r["page_id"], {})[r["record_type"]] = r
    for p in pairs.values():
        assert p["metadata"]["concurrent_to"] == p["conversion"]["record_id"] and p["conversion"]["concurrent_to"] == p["metadata"]["record_id"]
    assert pairs[1]["conversion"]["block"] == "One\n\nTwo l" and pairs[2]["conversion"]["block"] == ""
    links = json.loads(pairs[1]["metadata"]["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert links == {"Title": "T & U", "Links": [{"path": "A@/href", "url": "/x"}]}
    blob = b"".join(warc.serialized(r.asDict()) for r in out)
    back = list(warc.parse_records(blob))
    assert [b.decode() for _, b in back] == [r["block"] for r in out] and [h["WARC-Record-ID"] for h, _ in back] == [r["record_id"] for r in out]
    assert warc.serialize(warc.derivatives(responses)).count() == 8
    raw = b"".join(warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", r["record_id"]), ("WARC-Payload-Digest", r["payload_digest"])], bytes(r["block"])) for r in responses.collect())
    (tmp_path / "x.warc").write_bytes(raw)
    assert warc.derivatives(warc.read_responses(spark, str(tmp_path / "x.warc"))).count() == 8
    assert warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0
