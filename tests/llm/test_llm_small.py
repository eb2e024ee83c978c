"""The operators' Python parts against brute force; no Spark."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillsieve.llm import common, elias_fano, html, langid, near_copies, packing, quality, simhash, token_files
from quillsieve.llm.tokenizing import ChunkEncoder

texts = st.text(alphabet=st.sampled_from("aB é\n\t .É!#-ſŁ\u0301×ß\x0b\x0c\xa0　 'sß1中😀"), max_size=40)


@given(st.lists(st.integers(0, 2**40), max_size=300), st.data())
def test_elias_fano(values, data):
    values.sort()
    code, end = elias_fano.decode(b"xx" + elias_fano.encode(np.array(values, np.uint64)) + b"tail", 2)
    a, b = sorted(data.draw(st.tuples(st.integers(0, 310), st.integers(0, 310))))
    assert code.slice(a, b).tolist() == values[a:b]
    assert code.all().tolist() == values and end == 2 + len(elias_fano.encode(np.array(values, np.uint64)))
    for _ in range(min(20, len(values))):
        i = data.draw(st.integers(0, len(values) - 1))
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20_000))
    assert len(elias_fano.encode(ends)) < 20_000 * 8 / 4


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 65535), min_size=1, max_size=9)), min_size=1, max_size=40))
def test_token_blocks(docs):
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    content = token_files.pack_block([d for d, _ in docs], [np.array(x, "<u2").tobytes() for _, x in docs], 2) + b"\n"
    block = token_files.Block(content)
    assert block.doc_ids() == [d for d, _ in docs]
    assert [block.document(i).tolist() for i in range(len(docs))] == [x for _, x in docs]
    for bad in (content[:-1], content[:10], content[:20] + bytes([content[20] ^ 1]) + content[21:]):
        with pytest.raises(ValueError):
            token_files.Block(bad)


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_chunks_give_the_tokenizers_ids(name, spaces):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    of = ChunkEncoder(public_tokenizers.path(name), spaces)

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(texts, st.text(max_size=30)))
    def same(text):
        assert np.frombuffer(of.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    same()
    for text in ("", " ", "  a  b \n\n c", "<|endoftext|> x<|startoftext|>", "don't we'll\nI'm", "a" * 300 + " " + "b" * 300, "\xa0\xa0 b", "x   y"):
        assert np.frombuffer(of.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def brute_simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(deadline=None)
@given(st.one_of(texts, st.none()))
def test_simhash(text):
    assert simhash.fingerprint(text) == brute_simhash(text)


def test_simhash_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    text = " ".join(f"w{i % 37}" for i in range(200))
    assert simhash.fingerprint(text) == brute_simhash(text)


def test_linked_fingerprints_share_an_anchor():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for flips in range(4):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        ka, oa = simhash.anchors_of(base.view(np.int64))
        kb, ob = simhash.anchors_of(other.view(np.int64))
        at = {}
        for k, o in zip(ka.tolist(), oa.tolist(), strict=True):
            at.setdefault(o, set()).add(k)
        to = {}
        for k, o in zip(kb.tolist(), ob.tolist(), strict=True):
            to.setdefault(o, set()).add(k)
        assert all(at[x] & to[y] for x, y in zip(base.view(np.int64).tolist(), other.view(np.int64).tolist(), strict=True))
        assert max(map(len, at.values())) == 34


def test_sketches_agree_where_min_hashes_do():
    rng = np.random.default_rng(5)
    for n in (1, 20, 300, 5000):
        left, right = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        near = np.concatenate([left[: n - n // 10], right[: n // 10]])
        sketches = np.array([np.frombuffer(near_copies.sketch_of(np.unique(s))[0], np.uint8) for s in (left, right, near)])
        assert near_copies.near_sketches(sketches)(0, np.array([1, 2])).tolist() == [False, True]
        assert (sketches[0] == sketches[1]).sum() < 10


def test_forest_spans_links():
    rng = np.random.default_rng(4)
    a = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64))
    a = np.unique(a)

    def count(pairs):
        root = {int(x): int(x) for x in a}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        return len({find(int(x)) for x in a})

    every = [(int(x), int(y)) for x in a for y in a if x < y and (int(x) ^ int(y)).bit_count() <= 3]
    found = simhash.forest(a, None)
    assert count(found) == count(every) and len(found) < len(a)
    assert all((x ^ y).bit_count() <= 3 for x, y in found + simhash.forest(a[:20], a[20:]))


sizes = st.lists(st.integers(1, 100), max_size=60)


@settings(deadline=None, max_examples=60)
@given(sizes, st.integers(0, 5))
def test_evolved_packings_are_whole(sizes, seed):
    first = packing.best_fit([], list(range(len(sizes))), sizes, 100)
    best = packing.evolve(sizes, 100, seed, [])
    again = packing.evolve(sizes, 100, seed + 1, [best, first])
    for bins in (first, best, again):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(again) <= len(best) <= len(first)


def test_crossover_and_mutation_keep_every_item():
    import random

    rng = random.Random(1)
    own = [rng.randrange(1, 70) for _ in range(200)]
    a = packing.best_fit([], list(range(200)), own, 100)
    order = list(range(200))
    rng.shuffle(order)
    b = [[i] for i in order]
    for child in (packing.crossover(a, b, own, 100, rng), packing.crossover(b, a, own, 100, rng), packing.mutate(a, own, 100, rng)):
        assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(own[i] for i in x) <= 100 for x in child)


def test_the_genetic_algorithm_beats_best_fit():
    """Triplets that fill bins exactly, where longest-first best fit errs."""
    import random

    rng, own = random.Random(5), []
    for _ in range(20):
        a, b = rng.randrange(26, 49), rng.randrange(26, 34)
        own += [a, b, 100 - a - b]
    best = packing.evolve(own, 100, 1, [], population=12, generations=150)
    assert 20 <= len(best) < len(packing.best_fit([], list(range(60)), own, 100))


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    lengths = [1, 4, 2, 5]
    scores, t = rng.normal(size=sum(lengths)), rng.normal(size=(2, 2))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    got, pairs = quality.marginals(scores, starts, t)
    for s, n in zip(starts, lengths, strict=True):
        p, total, both = np.zeros(n), 0.0, np.zeros((n - 1, 2, 2))
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(scores[s + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            p += w * np.array(y)
            for i in range(n - 1):
                both[i, y[i], y[i + 1]] += w
        assert got[s : s + n] == pytest.approx(p / total)
        before = sum(m - 1 for a, m in zip(starts, lengths, strict=True) if a < s)
        assert pairs[before : before + n - 1] == pytest.approx(both / total)


def test_quality_of_any_text():
    good, bad = ["This is a plain line of text, as it should be.\nAnd here is another one."] * 9, ["BUY!! NOW!! ### $$$\n### CHEAP!!"] * 9
    model = quality.fit(good + bad, [1] * 9 + [0] * 9)
    p = quality.predict(model, [None, "", "\n\n\n", good[0], bad[0], good[0] * 3000, "x" * 3_000_000, "😀"])
    assert ((0 <= p) & (p <= 1)).all() and p[3] > 0.7 > p[4] and p[0] == p[1]
    assert quality.fit(good, [1] * 9) is None and (quality.predict(None, ["a", None]) == 0.5).all()


def test_language_of_any_text():
    samples = {"en": "the and of it was that this with", "fr": "le la des une que pour les dans", "de": "der die das und nicht ein mit auf"}
    model = langid.fit([s for s in samples.values() for _ in range(5)], [k for k in samples for _ in range(5)])
    langs, scores = langid.predict(model, [None, "", "123 !?", *samples.values(), "une " * 600_000, "x"])
    assert langs[:7] == ["und", "und", "und", "en", "fr", "de", "fr"] and langs[7] in samples and ((scores >= 0) & (scores <= 1)).all()
    assert langid.fit([], []) is None and langid.predict(None, ["abc"])[0] == ["und"]
    one = langid.fit(["abc abc", "abd"], ["xx", "xx"])
    assert langid.predict(one, ["the cat"])[0] == ["xx"]


def memory_of_this_process() -> int:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) // 1024


def test_free_memory_goes_back_and_slices_hold_all_rows():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, a + n))}) for a, n in ((0, 25), (25, 0), (25, 10), (35, 3))]
    pinned, before = [], []

    def given():
        for b in batches:
            held = [bytes(60_000) + bytes([k % 256]) for k in range(2000)]  # below the size that goes back by itself
            pinned.append(held[::100])  # so that the others can't be cut off the heap's end
            del held
            before.append(memory_of_this_process())
            yield b

    slices = list(common.in_slices(given(), 10))
    assert [x for b in slices for x in b.column(0).to_pylist()] == list(range(38)) and max(b.num_rows for b in slices) == 10
    assert before[-1] - memory_of_this_process() > 60


def test_scores_do_not_depend_on_what_stands_beside():
    rng = np.random.default_rng(8)
    some = [" ".join("".join(rng.choice(list("abcdefgh" if k % 2 else "hijklmno"), 6)) for _ in range(40)) for k in range(60)]
    model = langid.fit(some, ["x", "y"] * 30, rounds=5)
    assert langid.predict(model, some)[1].tolist() == [langid.predict(model, [t])[1][0] for t in some]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    closest = min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=9)
    assert closest >= (1 if n <= 2 else 2 if n == 3 else 3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div><form><input name=q>Search</form>
<article><h1>{title}</h1>{body}<div class="ad">Buy {title}</div><section class="comments"><p>{title} great</p></section></article>
<div class=sidebar><p>More</p></div><footer>&copy; me"""


def page(k: int) -> tuple[str, str]:
    paragraphs = [f"Text {k} number {i} &amp; more\n  of <b>it</b>all" for i in range(k % 4 + 1)]
    html_text = PAGE.format(menu="".join(f"<li><a href=/{i}>m{i}" for i in range(k % 3 + 2)), title=f"Title {k}", body="<p>".join(["", *paragraphs]) + ("<ul><li>a<li>b</ul>" if k % 2 else ""))
    want = " ".join([f"Title {k}", *[f"Text {k} number {i} & more of itall" for i in range(k % 4 + 1)], *(["a b"] if k % 2 else [])])
    return html_text, want


def test_wrapper_and_rules_find_the_article():
    wrapper = html.infer([page(k)[0] for k in range(8)])
    for k in range(40):
        text, want = page(k)
        assert html.extract(text, wrapper) == want == html.extract(text, None)


def test_wrapper_has_optional_repeated_and_slots():
    a, b = (html.hypothesis(html.parse(f"<body><h1>{t}</h1>{x}<p>same</p></body>")) for t, x in (("A", "<ul><li>1<li>2</ul>"), ("B", "")))
    text = html.as_expression(html.align(a, b))
    assert "<h1>(#)" in text and "<ul>(<li>(#)+)?" in text and '<p>("same")' in text


def test_a_host_without_article_loses_shared_texts_and_links():
    pages = [f"<body><div>All rights</div><div class=x><p>Story {k} here</p><p>end {k}</p></div><div class=y><a href=/>home</a> <a href=/>more {k}</a></div></body>" for k in range(5)]
    wrapper = html.infer(pages)
    assert [html.extract(p, wrapper) for p in pages] == [f"Story {k} here end {k}" for k in range(5)]


@pytest.mark.parametrize("quote", "\"'")
def test_a_long_attribute_stays_in_its_tag(quote):
    value = "<b>not text</b></article>" * 1000
    assert html.extract(f"<article>a <i data-x={quote}{value}{quote}>b</i> c</article>", None) == "a b c"
    assert html.extract("<p title='x>open</p>" + "<p>it</p>", None) == "open it"


def test_a_text_that_one_page_has_is_kept():
    pages = [f"<body><p>Shared line</p><div>Story {k} here</div>{'<h2>Only here</h2><blockquote><p>A quote</p></blockquote>' if k == 4 else ''}</body>" for k in range(8)]
    wrapper = html.infer(pages)
    assert [html.extract(p, wrapper) for p in pages] == [f"Story {k} here" + " Only here A quote" * (k == 4) for k in range(8)]


def test_names_of_states_and_words_in_values_strike_nothing_out():
    inside = '<p class="overflow-hidden">a</p><p title="the hidden truth">b</p><p data-role="ad">foo<img src=x>bar</p>'
    for body in (f"<article>{inside}</article>", f'<div class="layout has-sidebar">{inside}</div>', f'<main class="with-comments is-open">{inside}</main>'):
        text = f"<body>{body}<p hidden>not shown</p></body>"
        assert html.extract(text) == "a b foobar" == html.extract(text, html.infer([text] * 3))


NO_ARTICLE = """<body class="home"><div class="zx1"><p>Site of things</p><p>All you need</p></div><div class="q7"><a href=/a>Home {k}</a> <a href=/b>About</a></div>
<div class="ads banner-wrap"><h1>Title {k}</h1><p>The story number {k} goes on &amp; on, at length.</p>{more}</div>
<div class="content"><p>Terms apply. Contact us.</p></div></body>"""


def no_article(k: int) -> tuple[str, str]:
    more = "".join(f"<p>Part {i} of {k * 7} has words.</p>" for i in range(k % 4))
    text = " ".join([f"Title {k} The story number {k} goes on & on, at length.", *(f"Part {i} of {k * 7} has words." for i in range(k % 4))])
    return NO_ARTICLE.format(k=k, more=more), text


def test_the_wrapper_finds_what_names_mislead_about():
    """The story is in an element named as an advert, what all pages share in one named content; one page alone can't tell."""
    wrapper = html.infer([no_article(k)[0] for k in range(10)])
    alone = 0
    for k in range(20):
        text, want = no_article(k)
        assert html.extract(text, wrapper) == want
        alone += html.extract(text) == want
    assert not alone


def test_partial_wrappers_merge(monkeypatch):
    pages = [no_article(k)[0] for k in range(12)]
    rows = pa.RecordBatch.from_arrays([pa.array(["h"] * 12), pa.array(pages)], names=["host", "html"])
    parts = [x for k in range(0, 12, 5) for x in html._partials(iter([rows.slice(k, 5)]))]
    wrapper, seen = html._merge(pa.Table.from_batches(parts))
    compiled = html.compile_wrapper(wrapper, len(seen))
    assert len(seen) == 3 and all(html.extract(*[no_article(k)[0], compiled]) == no_article(k)[1] for k in range(12))
    monkeypatch.setattr(html, "HOSTS", 2)
    several = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array(pages[:3])], names=["host", "html"])
    assert sorted(h for x in html._partials(iter([several])) for h in x.column(0).to_pylist()) == ["a", "b", "c"]


def test_a_repeated_page_shares_nothing_with_itself():
    text = no_article(3)[0]
    assert "The story number 3" in html.extract(text, html.infer([text] * 9))


def test_wide_and_deep_elements_keep_their_texts():
    wide = "<body>" + "".join(f"<{('p', 'h2', 'ul', 'table')[(k * k) % 4]} class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}>x{k}" for k in range(3000)) + "</body>"
    deep = "<div>" * 3000 + "<p>far</p><div class=ad>buy</div>" + "</div>" * 3000 + "<p>near</p>"
    wrapper = html.infer([wide, deep, wide + "<p>y</p>"])
    assert html.extract(wide, wrapper) == " ".join(f"x{k}" for k in range(3000))
    assert html.extract(deep, wrapper) == "far near"


@pytest.mark.parametrize("bad", ["", None, "<", "<p", "<a href='x", "</p></p>text", "<div>" * 5000 + "deep", "<!-- x", "<script>x", "&amp;&#x41;&nope;", "<p>a<table><tr><td>b<td>c</table>"])
def test_broken_pages(bad):
    for wrapper in (None, html.infer(["<p>x</p>"])):
        assert isinstance(html.extract(bad, wrapper), str)
    assert html.extract("<div>" * 5000 + "deep", None) == "deep" and html.extract("&amp;&#x41;", None) == "&A"


keys = st.lists(st.sampled_from("abcd"), max_size=12)


@settings(deadline=None)
@given(keys, keys)
def test_matches(x, y):
    found = html.matches(x, y)
    assert all(x[i] == y[j] for i, j in found) and all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(found) == best[-1][-1]


def test_large_samples_are_aligned_in_time():
    import random

    rng = random.Random(1)
    deep = "<div>" * 5000 + "deep"
    wide = ["".join(f"<{rng.choice(['p', 'h2', 'ul', 'table'])}>x{k}" for k in range(20_000)) for _ in range(3)]
    wrapper = html.infer([deep, *wide])
    assert all(html.extract(w, wrapper) for w in wide)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "x", " ", "<article>", "</article>", "<li>", "<ul>", "</ul>", "<br>", "<td>", "<script>", "</script>", "<!--", "-->", "&lt;"]), max_size=25))
def test_any_markup_is_taken(parts):
    text = "".join(parts)
    assert isinstance(html.extract(text, html.infer([text, "<p>y</p>", text + "z"])), str)


def test_crc_is_of_32_bit_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(struct.pack("<II", 1, 2))
