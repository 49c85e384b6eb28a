"""Plain versions against the kernels, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waveline.llm import common, decontaminate, html_text, language, license_scan, media, near_duplicates, packing, quality, suffix_array, suffix_dedup, tokens


def shingles(text):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("trial", range(30))
def test_suffix_order(trial):
    rng = np.random.default_rng(trial)
    t = rng.integers(1, 2 + trial % 4, rng.integers(1, 200)).astype(np.uint8)
    t = np.append(np.tile(t, 1 + trial % 3), 0).astype(np.uint8)
    raw = t.tobytes()
    expected = sorted(range(len(t)), key=lambda i: raw[i:])
    order = suffix_array.suffix_order(t, 1024)
    assert order.tolist() == expected
    words = suffix_array._words(t)
    got = suffix_array.common_prefixes(order, words, suffix_array.jump_hashes(words), 1024)
    for x in range(1, len(t)):
        a, b = raw[expected[x - 1] :], raw[expected[x] :]
        n = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert got[x] == n


def test_patience():
    a, b = "the quick brown fox jumps over the lazy dog".split(), "a quick fox jumps over a lazy lazy dog".split()
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs) == 6
    assert license_scan.patience([], a) == []


def test_licenses():
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        words = license_scan.hashes([f"some words before. {text} And after."])[0]
        cues = [i for i, w in enumerate(words) if int(w) in scanner.places]
        assert name in [s[2] for s in scanner.spans(words, cues, 0.8)], name


def test_ranker():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = (x[:, 3] > -0.8).astype(int)
    s = quality.fit(x, y).score(x)
    assert ((s >= 0.5) == y).mean() > 0.97
    assert (quality.fit(x[:0], y[:0]).score(x) == 0.5).all()
    assert quality.text_features(np.zeros(0, np.uint8)).shape == (quality.N_FEATURES,)


def test_html():
    page = """<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><header>Top</header><nav>menu</nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>One&nbsp;two<br>three <b>four<p>five &lt; six
    <div class="ad">buy</div><p>Short.</p></article><aside>side</aside><div id="comments"><p>reader says a lot of words here</p></div><footer>end</footer>"""
    assert html_text.main_text(page) == "Head & line One two three four five < six Short."
    for empty in (None, "", "<nav>x</nav>", "<p><b>"):
        assert html_text.main_text(empty) == ""


@pytest.mark.parametrize("n", [64, 128, 6400, 70_016, 700_032])
def test_media(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert media.load(media.store(payload)) == payload
    tensor, spans = media.features(np.frombuffer(payload, np.uint8))
    assert tensor.shape == (media.SLOTS, media.MELS) and np.isfinite(tensor).all()
    assert (spans[:, 0] < spans[:, 1]).all()


def test_media_blocks(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8)
    whole = np.concatenate(list(media._frames(samples)))
    monkeypatch.setattr(media, "BLOCK", 4096)
    assert np.allclose(np.concatenate(list(media._frames(samples))), whole, atol=1e-3)


def test_plan():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.3, 1, 5000).astype(int), 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    made = packing.plan(histogram)
    got = {}
    for pattern, n in made:
        assert sum(pattern) <= 4096 and n > 0
        for length in pattern:
            got[length] = got.get(length, 0) + n
    assert got == histogram
    assert sum(n for _, n in made) <= 1.01 * lengths.sum() / 4096 + 1
    assert packing.plan({}) == [] and packing.plan({4096: 2}) == [((4096,), 2)]


def test_tokens():
    from tokenizers import Tokenizer

    own, library = tokens.tokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(4)
    alphabet = "abcdeghst'lm ABC0123,.!? \n\t\v\x1céÉßñÇ-_/<|>ÀİΣσςæ①½éİ​你好K "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + "<|endoftext|>x" * (i % 9 == 0) for i in range(1500)]
    flat, at = own.encode(pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert at[-1] == at[-2]


def test_containment():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    items = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(30)] + ["", "One, two!"]
    docs = ["", None, "one TWO", "..."]
    for _ in range(200):
        words = [word() for _ in range(rng.randint(0, 900))]
        item = rng.choice(items).split()
        for i in range(len(item)):
            if rng.random() < 0.02:
                item[i] = word()
        cut = rng.randint(0, len(words))
        docs.append(" ".join(words[:cut] + item + words[cut:]))
    index = decontaminate.Index(list(range(len(items))), items)
    got = {(r, index.ids[k]) for r, k, _, _ in index.matches(pa.array(docs), 0.8)}
    expected = {(r, k) for r, d in enumerate(docs) for k, i in enumerate(items) if shingles(i) and len(shingles(i) & shingles(d)) >= 0.8 * len(shingles(i))}
    assert got == expected


def test_pruning_keeps_what_is_likely():
    needed = near_duplicates.needed_matches(0.8)
    assert list(needed) == sorted(needed) and needed[-1] < 0.8 * near_duplicates.BANDS * near_duplicates.ROWS


def test_html_region_follows_the_text():
    body = "".join(f"<p>{'Many words of running text in a paragraph. ' * 6}{i}</p>" for i in range(5))
    whole = " ".join(f"{'Many words of running text in a paragraph. ' * 6}{i}" for i in range(5))
    card = '<article class="card"><h3>Teaser</h3><p>Read on</p></article>'
    links = "<ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(30)) + "</ul>"
    for page in (f"<body><main>{body}{card}</main></body>", f"<body><div>{body}</div><div>{links}</div>{card}</body>", f"<body><div>{links}</div><div><div>{body}</div>{card}</div></body>"):
        text = html_text.main_text(page)
        assert whole in text and "link" not in text
    # all articles that hold content, and neither links nor cards without any
    halves = body[: len(body) * 3 // 5], body[len(body) * 3 // 5 :]
    text = html_text.main_text(f"<body><div>{links}</div><article>{body}</article><article>{body}</article>{links}</body>")
    assert text.count("paragraph.") == 60 and "link" not in text
    assert html_text.main_text(f"<body><div>{links}</div><section>{halves[0]}</section><section>{halves[1]}</section></body>").count("paragraph.") == 30


def test_containment_of_short_items():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(3000))
    items = [" ".join(word() for _ in range(1 + i % 36)) for i in range(720)]
    docs = []
    for item in items:
        words, held = [word() for _ in range(1500)], item.split()
        if len(held) > 16 and rng.random() < 0.5:
            held[rng.choice([0, -1])] = word()
        cut = rng.randint(0, len(words))
        docs.append(" ".join(words[:cut] + held + words[cut:]))
    index = decontaminate.Index(list(range(len(items))), items)
    got = {(r, index.ids[k]) for r, k, _, _ in index.matches(pa.array(docs), 0.8)}
    sets, have = [shingles(i) for i in items], [shingles(d) for d in docs]
    assert got == {(r, k) for r, d in enumerate(have) for k, s in enumerate(sets) if len(s & d) >= 0.8 * len(s)}
    assert {k for _, k in got} >= {k for k, i in enumerate(items) if 5 <= len(i.split()) <= 16}


def test_symbols_are_no_letters():
    from waveline.llm import language

    texts = pa.array(["\U0001f389\U0001f389 123", "\U0001d7d8\U0001d7d9", "\U00010428 a", "\U00020000", None])
    assert language.counts(texts)[3].tolist() == [False, False, True, True, False]
    model = language.Model(["en"], np.zeros((1 << language.BITS, 1)), np.zeros(1), np.ones(1 << language.BITS))
    assert model.predict(texts)[0] == ["und", "und", "en", "en", "und"]


@pytest.mark.parametrize("inserted", [0, 9, 20])
def test_license_with_insertion(inserted):
    scanner = license_scan.Scanner()
    text = license_scan.TEMPLATES["MIT grant"].replace("any person", "any person " + " ".join(f"x{i}" for i in range(inserted)))
    words = license_scan.hashes([f"some words before. {text} And after."])[0]
    cues = [i for i, w in enumerate(words) if int(w) in scanner.places]
    assert ("MIT grant", 1.0, 3, 23 + inserted) in [(name, share, a, b) for a, b, name, share in scanner.spans(words, cues, 0.8)]


def test_licenses_without_a_cue_list():
    scanner = license_scan.Scanner()

    def found(text):
        words = license_scan.hashes([text])[0]
        return [s[2] for s in scanner.spans(words, [i for i, w in enumerate(words) if int(w) in scanner.places], 0.8)]

    assert found("Available under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]
    assert found("Released under the MIT Licence.") == ["MIT"] and found("Issued under the MIT License.") == ["MIT"]
    assert found("# SPDX-License-Identifier: EUPL-1.2") == ["SPDX line"] and found("Copyright (c) 2020 Someone") == ["Copyright line"]
    for text in license_scan.TEMPLATES.values():  # whatever words are damaged, one cue is left
        words = license_scan.hashes([text])[0].tolist()
        kept = sorted(words, key=lambda w: w in scanner.places)[: -(-4 * len(words) // 5)]
        assert any(w in scanner.places for w in kept), text


def thue_morse(n, first, second):
    return "".join(second if bin(i).count("1") % 2 else first for i in range(n))


def test_words_with_structure_are_apart():
    from tokenizers import Tokenizer

    texts = [thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a"), thue_morse(64, "a", "b"), thue_morse(64, "b", "a")]
    hashes, _ = common.word_hashes(pa.array([" ".join(texts)]))
    assert len(set(hashes.tolist())) == 4
    own, library = tokens.tokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    flat, at = own.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_follow_the_words_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 40, 127, 128, 129, 700]))) for _ in range(300)]
    one, _ = common.word_hashes(pa.array([w for w in words]))
    other, at = common.word_hashes(pa.array(["!! " + " , ".join(reversed(words)), "", None]))
    assert one.tolist() == other.tolist()[::-1] and at.tolist() == [0, 300, 300, 300]
    assert len(set(one.tolist())) == len(set(words))


@pytest.mark.parametrize("piece", [1 << 18, 700])
def test_anchors(monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    rng = np.random.default_rng(3)
    length = 96
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 50, 95, 96, 97, 900, 2000)] + [np.full(500, 97, np.uint8)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    grams = suffix_dedup._grams(data) & ~suffix_dedup._PLACE
    expected = set()
    for text, end in zip(texts, ends, strict=True):
        for s in range(end - len(text), end - length + 1):
            inside = grams[s : s + length - suffix_dedup.GRAM + 1]
            expected.add(s + int(np.flatnonzero(inside == inside.min())[0]))
    assert suffix_dedup._anchors(data, ends, length).tolist() == sorted(expected)


@pytest.mark.parametrize("tile,sides", [(512, False), (3, False), (5, True)])
def test_links(monkeypatch, tile, sides):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = rng.integers(1 << 60, size=40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(25, 40), replace=False), rng.integers(1 << 60, size=rng.integers(0, 6)).astype(np.uint64)])) for _ in range(30)]
    copies = rng.integers(1, 4, 30)
    side = rng.random(30) < 0.5 if sides else None
    plain = [set(s.tolist()) for s in sets]
    linked = lambda i, j: i != j and (side is None or side[i] != side[j]) and 10 * len(plain[i] & plain[j]) >= 8 * len(plain[i] | plain[j])
    label, total = near_duplicates.links(sets, copies, 0.8, side)
    assert total.tolist() == [sum(int(copies[j]) for j in range(30) if linked(i, j)) for i in range(30)]
    root = list(range(30))
    for _ in range(30):
        for i in range(30):
            for j in range(30):
                if linked(i, j):
                    root[i] = root[j] = min(root[i], root[j])
    assert label.tolist() == root


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if items[i] <= room and room not in rooms[:j]:
                place(i + 1, rooms[:j] + [room - items[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_plan_against_the_optimum():
    rng = random.Random(9)
    for _ in range(25):
        items = [rng.randint(1, 40) for _ in range(rng.randint(1, 10))]
        histogram = {x: items.count(x) for x in items}
        assert sum(n for _, n in packing.plan(histogram, 40)) == optimum(items, 40)


def test_the_program_places_most_tokens():
    rng = np.random.default_rng(2)
    values, counts = np.unique(np.clip(rng.lognormal(6.3, 1, 5000).astype(int), 1, 4095), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    total = sum(n * c for n, c in histogram.items())
    assert sum(sum(p) * n for p, n in packing.configurations(histogram, 4096)) > 0.6 * total
    assert sum(n for _, n in packing.plan(histogram)) <= -(-total // 4096) + 3


def test_knapsack():
    rng = np.random.default_rng(4)
    for _ in range(20):
        weights = np.where(rng.random(25) < 0.4, rng.random(25), 0.0)
        weights[0] = 0
        best = np.zeros(25)
        for c in range(1, 25):
            best[c] = max([best[c - 1], *(weights[z] + best[c - z] for z in range(1, c + 1))])
        used = packing.price(weights)
        assert used @ np.arange(25) <= 24 and np.isclose(used @ weights, best[24]) and not used[weights == 0].any()


PROSE = "Many words of running text stand in this paragraph of the page. " * 6
PARAGRAPH = f"<p>{PROSE}</p>"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">link {i}</a></li>' for i in range(12)) + "</ul>"
PAGES = {  # html: how often the paragraph is wanted, what else is wanted, what isn't
    "article": (f"<body>{MENU}<article>{PARAGRAPH}<p>Short end.</p></article></body>", 1, ["Short end."], ["link"]),
    "article in main": (f"<main>{PARAGRAPH}<article>{PARAGRAPH}</article>{PARAGRAPH}</main>", 3, [], []),
    "main alone": (f"<div>Top</div><main>{PARAGRAPH}</main><div>End</div>", 1, [], ["Top", "End"]),
    "two divs": (f"<body><div>{PARAGRAPH}</div><div>{PARAGRAPH}</div></body>", 2, [], []),
    "three sections": (f"<body>{MENU}<section>{PARAGRAPH}</section><section>{PARAGRAPH}</section><section>{PARAGRAPH}</section></body>", 3, [], ["link"]),
    "div with header and end": (f"<body><div>My site</div><div>{PARAGRAPH}{PARAGRAPH}</div><div>All rights</div></body>", 2, [], ["My site", "All rights"]),
    "menu in the middle": (f"<body><div>{PARAGRAPH}</div>{MENU}<div>{PARAGRAPH}</div></body>", 2, [], ["link"]),
    "marked section": (f"<article>{PARAGRAPH}<![foo[bar]]>{PARAGRAPH}</article>", 2, [], ["foo"]),
    "conditional": (f"<article><![if IE]>{PARAGRAPH}<![endif]></article>", 1, [], ["IE"]),
    "doctype with a subset": (f'<!DOCTYPE html [ <!ENTITY x "y"> ]><body><article>{PARAGRAPH}</article>', 1, [], ["]", "ENTITY"]),
    "stray declaration": (f"<article><!]]>{PARAGRAPH}<![>{PARAGRAPH}</article>", 2, [], ["]"]),
    "comment without end": (f"<article>{PARAGRAPH}</article><!-- {PARAGRAPH}", 1, [], ["--"]),
    "tag without end": (f"<article>{PARAGRAPH}<p>More here</p></article><a href='x", 1, ["More here"], ["href"]),
    "quote without end": (f'<article><p class="x>{PROSE}</p>{PARAGRAPH}</article>', 2, [], ["class"]),
    "script without end": (f"<article>{PARAGRAPH}</article><script>var a = 1; {PARAGRAPH}", 1, [], ["var"]),
    "processing instruction": (f"<?xml version='1.0'?><article>{PARAGRAPH}<?php echo 1 ?></article>", 1, [], ["php", "xml"]),
    "unclosed blocks": (f"<article><div><p>{PROSE}<p>{PROSE}<ul><li>one<li>two</article>", 2, ["one two"], []),
    "advert and comments": (f'<article>{PARAGRAPH}<div class="ad">{PARAGRAPH}</div><section id="comments">{PARAGRAPH}</section></article>', 1, [], []),
    "class names of content": ("<article>" + "".join(f'<div class="{c}">{PARAGRAPH}</div>' for c in ("related-work", "search-results", "side-effects", "share-price", "alert", "footer-notes")) + "</article>", 6, [], []),
    "class names of menus": (f'<article>{PARAGRAPH}<div class="related">{MENU}</div><div class="share"><a href="/">Share it</a></div></article>', 1, [], ["link", "Share"]),
    "hidden": (f'<article>{PARAGRAPH}<div style="display: none">{PARAGRAPH}</div><p hidden>{PROSE}</p></article>', 1, [], []),
    "teaser cards": (f'<main>{PARAGRAPH}{PARAGRAPH}<article class="card"><h3>Teaser</h3></article></main>', 2, [], []),
    "list of an article": (f"<article>{PARAGRAPH}<ul><li>Salt</li><li>Oil &amp; flour</li></ul>{PARAGRAPH}</article>", 2, ["Salt Oil & flour"], []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_shapes(name):
    html, paragraphs, wanted, unwanted = PAGES[name]
    text = html_text.main_text(html)
    assert text.count(PROSE.strip()) == paragraphs
    assert all(x in text for x in wanted) and not any(x in text for x in unwanted), text


def test_clustering_decides(monkeypatch):
    pages = [PAGES[n][0] for n in ("two divs", "div with header and end", "main alone", "three sections", "class names of content")]
    before, cluster = [html_text.main_text(p) for p in pages], html_text._content_lines
    monkeypatch.setattr(html_text, "_content_lines", lambda r: ~cluster(r))
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) >= 3


def plain_features(samples):
    """The media features from their definitions, one output sample and frame at a time."""
    x = np.concatenate([np.zeros(media.TAPS - 1), samples.astype(float) - 128])
    n = media.UP * media.TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(media.UP, media.DOWN)) * np.hamming(n)
    taps = taps / taps.sum() * media.UP / 128
    y = []
    for j in range(-(-len(samples) * media.UP // media.DOWN)):
        at, phase = divmod(j * media.DOWN, media.UP)
        y.append(sum(taps[k * media.UP + phase] * x[at + media.TAPS - 1 - k] for k in range(media.TAPS)))
    frames = max(0, -(-(len(y) - media.FRAME) // media.HOP)) + 1
    y = np.append(y, np.zeros((frames - 1) * media.HOP + media.FRAME - len(y)))
    _, _, bank = media._filters()
    rows = np.array([np.log(np.abs(np.fft.rfft(y[i * media.HOP : i * media.HOP + media.FRAME] * np.hanning(media.FRAME))) ** 2 @ bank + 1e-6) for i in range(frames)])
    cuts = [(i * frames // media.SLOTS, max(i * frames // media.SLOTS + 1, (i + 1) * frames // media.SLOTS)) for i in range(media.SLOTS)]
    tensor = np.array([rows[a:b].mean(axis=0) for a, b in cuts])
    energy, spans, opened = rows.mean(axis=1), [], None
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean()
    for i, e in enumerate([*energy, -np.inf]):
        if e >= low and opened is None:
            opened = i
        if e < low and opened is not None:
            if max(energy[opened:i]) >= high:
                spans.append((opened, i))
            opened = None
    return tensor, np.array(spans, float).reshape(-1, 2) * media.HOP * media.DOWN / media.UP / media.RATE


@pytest.mark.parametrize("n", [64, 640, 9600])
def test_media_against_the_definition(n):
    rng = np.random.default_rng(n)
    samples = np.clip(128 + np.repeat(rng.integers(1, 100, n // 64), 64) * rng.standard_normal(n) * 0.4, 0, 255).astype(np.uint8)
    tensor, spans = media.features(samples)
    expected, expected_spans = plain_features(samples)
    assert np.allclose(tensor, expected, atol=2e-2) and np.allclose(spans, expected_spans)


def test_gram_counts():
    texts = ["Ab 1c!", "", None, "éÉé  x", "ab ab ab"]
    row, feature, n, has = language.counts(pa.array(texts))
    assert has.tolist() == [True, False, False, True, True]

    def bucket(gram):
        x = 0
        for c in gram:
            x = x << 21 | ord(c)
        return ((x + len(gram)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.BITS)

    for i, text in enumerate(texts):
        folded = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        expected = {}
        for k in language.GRAMS:
            for j in range(len(folded) - k + 1):
                expected[bucket(folded[j : j + k])] = expected.get(bucket(folded[j : j + k]), 0) + 1
        own = row == i
        assert dict(zip(feature[own].tolist(), n[own].tolist(), strict=True)) == expected


def test_sparse_regression_learns():
    texts = pa.array([w * 5 for w in ("the cat ", "le chat ", "der hund ")] * 60)
    langs = ["en", "fr", "de"] * 60
    idf = np.ones(1 << language.BITS)
    row, feature, n, _ = language.counts(texts)
    model = language.fit(row, feature, n, langs, idf)
    assert (model.weights == 0).mean() > 0.99 and model.temperature != 1.0
    found, score = model.predict(pa.array(["the cat", "der hund", "99", None]))
    assert found == ["en", "de", "und", "und"] and score[2] == score[3] == 0 and (score[:2] > 0.5).all()


def test_ranker_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality.N_FEATURES))
    y = (x[:, 0] + x[:, 1] + rng.normal(size=60) > 0).astype(int)
    model = quality.fit(x, y, pairs=60_000, penalty=1e-2)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])  # every pair
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.5e-2 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        w += 0.2 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-2 * w)
    assert loss(model.weights) <= loss(w) + 0.01
    assert np.corrcoef(model.weights, w)[0, 1] > 0.97


def test_license_against_all_windows():
    templates = {"one": "alpha beta gamma delta epsilon", "two": "licensed under the theta rules of zeta", "three": "gamma gamma delta alpha"}
    scanner = license_scan.Scanner(templates, 0.8)
    words = {n: license_scan.hashes([t])[0].tolist() for n, t in templates.items()}
    rng = random.Random(12)
    for _ in range(300):
        name = rng.choice(list(templates))
        notice = templates[name].split()
        if rng.random() < 0.6:
            notice[rng.randrange(len(notice))] = "damaged"
        text = " ".join([f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] + notice + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))])
        own = license_scan.hashes([text])[0]
        found = scanner.spans(own, [i for i, w in enumerate(own.tolist()) if w in scanner.places], 0.8)
        best = {}  # the longest common subsequence of every window of the template's length
        for n, template in words.items():
            for a in range(len(own)):
                window = own[a : a + len(template)].tolist()
                table = np.zeros((len(window) + 1, len(template) + 1), int)
                for i, w in enumerate(window):
                    for j, v in enumerate(template):
                        table[i + 1, j + 1] = table[i, j] + 1 if w == v else max(table[i, j + 1], table[i + 1, j])
                best[n] = max(best.get(n, 0), table[-1, -1] / len(template))
        assert {f[2] for f in found} == {n for n, share in best.items() if share >= 0.8}, text
