"""PII, HTML, tokens, URLs and suffix dedup against brute force and the libraries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lendlens.llm import html_text, pii, sp_codec, suffix_dedup, token_files, url_filter


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ------------------------------------------------------------------------ PII


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(only(m)) <= 19 and luhn(only(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(only(m)) <= 15],
    }


def test_base_spans_random():
    rng = random.Random(1)
    for _ in range(15000):
        text = "".join(rng.choice("ab.@-+ 1234567890().%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text


DISGUISED = [
    ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("john at example dot com", "email", "john at example dot com"),
    ("jane dot doe at mail dot example dot org ok", "email", "jane dot doe at mail dot example dot org"),
    ("mail j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
    ("x\uff20example\uff0ecom", "email", "x\uff20example\uff0ecom"),
    ("user[at]host.org", "email", "user[at]host.org"),
    ("plus one five five five two three four five six seven eight", "phone", None),
    ("+\uff11 \uff15\uff15\uff15 \uff11\uff12\uff13 \uff14\uff15\uff16\uff17", "phone", None),
    ("one nine two dot one six eight dot one dot one", "ip", None),
    ("cuatro" + " uno" * 15, "card", None),
    ("4111\u200b1111 1111 1111", "card", None),
]


@pytest.mark.parametrize("text,kind,found", DISGUISED)
def test_disguises(text, kind, found):
    base = pii.base_spans(text)
    spans = pii.added_spans(text, base)[kind]
    assert [text[a:b] for a, b in spans] == [found or text]


@pytest.mark.parametrize("text", ["look at example.com", "he came at dot to", "one two three go", "Müller à Paris, 3 points", "12 dot 5 point 7"])
def test_clean_texts_gain_nothing(text):
    assert not any(pii.added_spans(text, pii.base_spans(text)).values())


def test_pii_rows(spark, docs, empty, texts):
    hidden = spark.createDataFrame([(90, "a@b.co and c (at) d (dot) org"), (91, "1." * 50000 + "@" * 1000)], "doc_id bigint, text string")
    got = rows_of(pii.find(docs.select("doc_id", "text").unionByName(hidden)))
    assert len(got) == docs.count() + 2 and pii.find(empty).count() == 0
    row = next(r for r in got if r["doc_id"] == 90)
    assert row["n_email"] == 1 and row["n_added"] == 1 and row["spans"] == "email:0:6,email:11:29"
    assert row["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()


# ----------------------------------------------------------------------- HTML

PAGES = [
    ("", ""),
    ("<p>one<p>two &amp; three&nbsp; four", "one\ntwo & three four"),
    ('<nav><a href="/">Home</a></nav><article><h1>Head</h1><p>A,  b.\n</p><p>C</p><aside>no</aside></article><footer>f</footer>', "Head\nA, b.\nC"),
    (
        '<body><div class="sidebar"><p>side, bar, long long text here, yes</p></div><div id="main"><h2>Head</h2><p>Hello, world.</p>'
        '<ul><li>item</li></ul></div><div class="comments"><p>great post, thanks, really</p></div><form><p>x</p></form></body>',
        "Head\nHello, world.\nitem",
    ),
    ('<div class="cookie-notice">We use cookies, ok?</div><main><section><p>A, b.</p></section><section><p>C</p></section><div class="ad">buy</div></main>', "A, b.\nC"),
    ('<script>var t="</p><p>no</p>";</script><p>yes</p><!-- <p>no</p> -->', "yes"),
    ("<table><tr><td>x<td>y</table>", "x\ny"),
    (
        '<div id="page" class="with-sidebar modal"><div class="page-header"><p>Site, name</p></div><main class="content"><div class="entry-header">'
        '<h1>T</h1></div><p>Body, text.</p><div class="related-post"><p>More, to, read</p></div><article class="comment"><p>Nice, one</p></article>'
        '</main><section id="comments"><article class="comment"><p>a, b, c, d, e</p></article></section></div>',
        "T\nBody, text.",
    ),
    ('<div class="content-sidebar-wrap"><div class="content"><p>Kept, here.</p><p>And this</p></div><div class="sidebar"><p>gone</p></div></div>', "Kept, here.\nAnd this"),
    ('<div><p>Long enough, with commas, to be the text of the page.</p></div><div><a href="a">l1</a> <a href="b">l2, l3, l4, l5</a></div>', "Long enough, with commas, to be the text of the page."),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_extract(source, text):
    assert html_text.extract(source) == text


def test_extract_hostile_input():
    for source in ("<" * 50000, '<a href="' * 20000, "<div>" * 30000 + "x", "<p>" * 30000, "<!--" * 20000, "</b>" * 50000, "&" * 50000):
        html_text.extract(source)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é x</p>", 5), (1, "u", "<p>é x</p>", 5), (2, None, None, 6), (None, "v", "", 7)], "page_id bigint, url string, html string, text int")
    got = sorted(rows_of(html_text.main_text(pages)), key=str)
    assert [r["n_chars"] for r in got] == [3, 3, 0, 0] and html_text.main_text(pages.limit(0)).count() == 0


def test_articles_of_given_pages(spark):
    import html

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert html_text.extract(r["html"]) == "\n".join(b for b in blocks if b)


# --------------------------------------------------------------- sentencepiece

EDGE = ["", " ", "  ", "a" * 3000, "\u2581", "\u2581\u2581a b", " \n ", "日本語テキスト", "\n\n\n", "x" * 33 + " " * 51 + "the", "<s> </s> <unk> <0x41>"]


def random_texts(alphabet, n, size):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_sentencepiece_equals_library(texts):
    vocabulary = sp_codec.vocabulary_of(sp_codec.default_model())
    every = EDGE + random_texts("ab e\n\t  \u2581é日🙂\x00\x01<s>'123 .ththeee\u200b", 800, 60) + [t or "" for t in texts.values()]
    ids, at = sp_codec.encode_batch(pa.array(every), vocabulary)
    for k, text in enumerate(every):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == vocabulary.library.encode(text) and sp_codec.decode(own, vocabulary) == vocabulary.library.decode(own)


def test_every_distinct_word_is_checked(texts):
    vocabulary = sp_codec.Vocabulary(sp_codec.default_model())
    every = EDGE + random_texts("ab e\n\t  \u2581é日🙂\x00\x01<s>'123 .ththeee\u200b", 300, 60) + [t or "" for t in texts.values()]
    plain, checked = (sp_codec.encode_batch(pa.array(every), vocabulary, verify=v) for v in (False, True))
    assert all((a == b).all() for a, b in zip(plain, checked, strict=True))
    for some in ([], [""], ["", ""], ["\n"], [" "], ["a"]):
        sp_codec.encode_batch(pa.array(some, pa.string()), vocabulary, verify=True)
    word = pa.array(["many plain words and one thing"])
    vocabulary.merge = lambda left, right, what=0: np.full(len(left), sp_codec._NONE, np.int32)  # merges nothing
    with pytest.raises(ValueError, match="library"):
        sp_codec.encode_batch(word, vocabulary, verify=True)


def test_agenda_equals_rounds():
    vocabulary = sp_codec.vocabulary_of(sp_codec.default_model())
    for text in random_texts("thean ", 200, 30):
        symbols = vocabulary.symbol[[ord(c) for c in "\u2581" + text.replace(" ", "")]]
        rounds, _ = sp_codec.merge_all(symbols, np.array([0, len(symbols)]), vocabulary)
        assert sp_codec.agenda(symbols.tolist(), vocabulary) == rounds.tolist()


def test_sentencepiece_rows(docs, empty, texts):
    model = sp_codec.default_model()
    library = sp_codec.vocabulary_of(model).library
    got = rows_of(sp_codec.digests(docs, model, check_every=1))
    assert len(got) == docs.count() and sp_codec.digests(empty, model).count() == 0
    for r in got:
        ids = library.encode(texts[r["doc_id"] or 1] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = rows_of(sp_codec.encode(docs, model))
    assert all(r["decoded"] == (texts[r["doc_id"] or 1] or "") for r in whole)


# ----------------------------------------------------------------- token files


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(300)), sorted(random.Random(3).randrange(10**9) for _ in range(500))])
def test_elias_fano(values):
    coded = token_files.EliasFano.of(np.array(values, np.int64))
    read, end = token_files.EliasFano.read(b"xx" + coded.to_bytes(), 2)
    assert read.all().tolist() == values and [read.select(i) for i in range(len(values))] == values
    if len(values) > 100:  # near the bound of 2 + log2(u/n) bits, samples and header aside
        assert end < len(values) * (3 + max(0, np.log2(values[-1] / len(values)))) / 8 + len(values) / 16 + 40


def test_pre_tokens_equal_library():
    encoder = token_files.pre_tokens_of(token_files.default_tokenizer())
    every = [*EDGE, "<|endoftext|>", "a <|endoftext|> b", "it's I'll we're 's 'll''s", *random_texts("ab e\n\t  é日 's'll're1²½ .!?'tdmvx\x85\xa0\x00\x1cª", 1500, 40)]
    ids, at = encoder.encode_batch(every)
    for k, text in enumerate(every):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, docs, empty, texts, tmp_path, monkeypatch):
    tokenizer = token_files.default_tokenizer()
    library = token_files.pre_tokens_of(tokenizer).library
    rows = [(k, t or "") for k, t in texts.items()] + [(1, texts[1]), (None, texts[1])]
    token_files.write(docs, str(tmp_path / "a"), tokenizer)
    got = {(r["doc_id"], r["start"]): r for r in rows_of(token_files.read(spark, str(tmp_path / "a")))}
    assert len(got) == len(rows)
    start = 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        r = got[k, start]
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write(empty, str(tmp_path / "b"), tokenizer)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_segment_select():
    ids = np.arange(100_000, dtype=np.uint32)
    ends = np.array([1, 10, 10, 70_001, 100_000])
    segment = token_files.Segment(token_files.write_segment(np.array([-5, -5, 7]), 2, ends, ids))
    assert segment.doc_ids == [None, None, -5, -5, 7] and segment.document(3)[0] == 10 and len(segment.document(2)) == 0


# ------------------------------------------------------------------------ URLs


def brute_rule(host, path):
    fit = [r for r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://a.example.org/en/12", "x://y://z/w", "http://b.com/fr/", "http://b.com/de/q?u", "http://acom/fr/", "http://casino-pills.net/win", "https://daily-weather.net/report", "http://é.net/ü#", "http://u@h:80?x/y", "http://notexample.org/es/1"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int")
    got = {r["page_id"]: r for r in rows_of(url_filter.judge(pages, url_filter.labelled_urls(spark)))}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        rule = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == url_filter.RULES[rule]
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0), url_filter.labelled_urls(spark)).count() == 0


def test_url_model_held_out(spark):
    """Words that are left out of the table are told apart by the n-grams they share."""
    held = spark.createDataFrame([(f"https://{w}.example.net/en/7", float(y)) for w, y in [("casino-royal", 1), ("free-pills", 1), ("spam-ads", 1), ("adult-chat", 1), ("mountain", 0), ("chess-club", 0), ("thermal", 0), ("orchard", 0)]], "url string, label double")
    judged = url_filter.judge(held.selectExpr("cast(label as bigint) AS page_id", "url"), url_filter.labelled_urls(spark), {})
    wrong = [r for r in rows_of(judged) if (r["verdict"] == "block") != bool(r["page_id"])] if url_filter.RULES else []
    assert len(wrong) <= 1


# ---------------------------------------------------------------- suffix dedup


def brute_removed(texts, match):
    """n_bytes, n_removed, n_spans and the digest of what is left, per document."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(hash(b[i : i + match]) for b in data for i in range(len(b) - match + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - match + 1):
            if count[hash(b[i : i + match])] > 1:
                mark[i] += 1
                mark[i + match] -= 1
        gone = np.cumsum(mark[: len(b)]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_run_index_against_brute_force():
    rng = random.Random(4)
    for trial in range(15):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(400, 768))) for _ in range(3)]
        contexts = []
        for _ in range(10):
            x = bytearray(rng.choice(base))
            if rng.random() < 0.7:
                x[rng.randrange(len(x))] = 99
            a = rng.randint(0, len(x) - 400)
            contexts.append(bytes(x[a : rng.randint(a + 400, len(x))]))
        if trial % 5 == 0:
            contexts = [b"a" * 600, b"a" * 450, b"ab" * 300]
        count = collections.Counter(x[i : i + 400] for x in contexts for i in range(len(x) - 399))
        for x, found in zip(contexts, suffix_dedup.repeated_windows(contexts), strict=True):
            assert found.tolist() == [i for i in range(len(x) - 399) if count[x[i : i + 400]] > 1]


@pytest.mark.parametrize("index_bytes", [suffix_dedup.INDEX_BYTES, 1500])
def test_suffix_dedup(spark, docs, empty, texts, monkeypatch, index_bytes):
    """Also with an index so small that anchors are refined."""
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index_bytes)
    common = " ".join(f"s{i}" for i in range(110))
    more = [(60 + i, f"{i} head " * i + common + f" tail {i} " * i) for i in range(8)]
    more += [(70, "ab" * 500), (71, common[:399]), (72, common[5:405]), (73, "z" * 1300)]
    rows = [*texts.items(), (1, texts[1]), (None, texts[1]), *more]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = rows_of(suffix_dedup.remove_repeats(both))
    have = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    want = collections.Counter((k, *x) for (k, _), x in zip(rows, brute_removed([t for _, t in rows], 400), strict=True))
    assert have == want and suffix_dedup.remove_repeats(empty).count() == 0


def test_anchors_of_long_batches(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 20000).astype(np.uint8)
    offsets = np.array([0, 300, 300, 9000, 20000])
    whole = suffix_dedup.anchors(data, offsets)
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 13)
    parts = suffix_dedup.anchors(data, offsets)
    covered = lambda x: sorted(w + 0 for a, b, d in zip(x["low"], x["high"], x["doc"], strict=True) for w in range(d * 100000 + a, d * 100000 + b + 1))
    assert covered(whole) == covered(parts) == [d * 100000 + s for d, n in enumerate(np.diff(offsets)) for s in range(max(0, n - 399))]


def brute_passage_words(texts, size):
    """Words in ``size`` words in a row that another row's text holds too."""
    split = [re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for t in texts]
    holders = collections.defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - size + 1):
            holders[tuple(w[i : i + size])].add(k)
    return [len({i + j for i in range(len(w) - size + 1) if len(holders[tuple(w[i : i + size])]) > 1 for j in range(size)}) for w in split]


def test_passages_under_400_bytes_are_counted(spark):
    """They stay by the byte rule; a repeat inside one document alone is none."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"{rng.choice('abcd')}{rng.randrange(10**5)}" for _ in range(n))
    passages = [" ".join(rng.choice(["of", "the", "ein", "é", "x"]) + str(rng.randrange(99)) for _ in range(n)) for n in (50, 51, 55, 60)]
    texts = [None, "", fresh(40), fresh(300), passages[2]]
    texts += [f"{fresh(rng.randrange(90))} {p} {fresh(rng.randrange(90))}" for p in passages for _ in range(3)]
    texts += ["\n".join([fresh(5), passages[1].replace(" ", "\n"), fresh(70)])]
    texts += [f"{(alone := fresh(80))} {alone}", (twice := fresh(60)), twice, "short copy", "short copy", "and " * 400, "so " * 200]
    near = fresh(900).split()
    texts += [" ".join(near), " ".join(near[:200] + ["new"] + near[201:480] + near[520:]), " ".join(near[:70] + near[30:90])]
    rows = [*zip([*range(len(texts) - 2), 7, None], texts, strict=True)]
    got = rows_of(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")))
    want = collections.Counter((k, n) for (k, _), n in zip(rows, brute_passage_words(texts, 51), strict=True))
    assert collections.Counter((r["doc_id"], r["n_passage_words"]) for r in got) == want
    short = [r for r in got if r["n_removed"] == 0 and r["n_passage_words"] > 0]
    assert len(short) >= 8  # what the byte rule alone says nothing of


def test_phrases_of_long_batches(monkeypatch):
    rng = random.Random(3)
    data = " ".join(rng.choice(["a", "bc", "def"]) for _ in range(12000)).encode()
    offsets = np.array([0, 90, 90, 9000, len(data)])
    whole = suffix_dedup.phrases(np.frombuffer(data, np.uint8), offsets)
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 12)
    parts = suffix_dedup.phrases(np.frombuffer(data, np.uint8), offsets)
    covered = lambda x: [w for a, b in zip(x["low"], x["high"], strict=True) for w in range(a, b + 1)]
    first = whole["first"].tolist()
    assert covered(whole) == covered(parts) == [w for a, b in zip(first, first[1:]) for w in range(a, b - 50)]
    assert suffix_dedup.word_counts(np.frombuffer(data, np.uint8), offsets).sum() == first[-1]
