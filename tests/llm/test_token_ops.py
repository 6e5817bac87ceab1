"""Token counts and packing against the libraries on whole texts; page text."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from eventlens.llm import html_text, packing, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "  a", "a  ", "a   b", "\n\n x\ty \n", "▁ ▁▁x", "naïve café, don't. it's! THE End.%%%", "<s> </s> <unk> <|endoftext|>",
    "a<|startoftext|>b <|STARTOFTEXT|>", "日本語 テキスト🙂 100 0 0a a0 .", "…,;' \"quoted.\" (x.) é.  nbsp em", "x" * 5000, "word. " * 30000,
]


def frame(spark, texts=TEXTS):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, slice string, item long")
    return docs.repartition(3)


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark), path).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096), t


def test_token_counts_of_repeated_rows_and_empty_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()) == [1, 2, 2]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def check_packing(rows, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= capacity for n in at.values())
    return len(at)


@pytest.mark.parametrize("how", [{}, {"group_items": 4, "fan_in": 2}])
def test_packing(spark, how):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(frame(spark), path, **how).collect()
    check_packing(rows)
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        for k, part in enumerate(parts):
            r = pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes())), t
    assert not pieces


@pytest.mark.parametrize("groups,over", [({}, 1.0001), ({"group_items": 10_000, "merge_items": 40_000}, 1.006)])
def test_tree_packs_about_as_well_as_one_pass(spark, groups, over):
    sizes = np.random.default_rng(2).integers(1, 2049, 120_000)
    items = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(sizes)), "size": sizes})).repartition(4)
    out = packing.pack(items, **groups).join(items, "item").toPandas()
    assert len(out) == len(sizes) and out.groupby("sequence_id")["size"].sum().max() <= 2048
    assert out["sequence_id"].nunique() <= over * (packing.best_fit(sizes, 2048).max() + 1)


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(frame(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_part_encoder_forgets_and_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE_PARTS", 50)
    coder = packing.PartEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [" ".join(rng.choice("äbcdé,. 0") * rng.randrange(1, 4) + str(i) for _ in range(20)) for i in range(40)]
    for a in range(0, 40, 8):
        part = pa.array(texts, pa.large_string()).slice(a, 8)
        ids, sizes = coder.documents(part.take(pa.array(np.arange(8))))
        want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[a : a + 8]]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_tree_packing_is_near_the_bound(spark):
    rng = random.Random(0)
    sizes = [rng.randint(1, 1500) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = packing.pack(items, 2048, group_items=400, fan_in=4).join(items, "item").withColumnRenamed("size", "length").collect()
    assert len(rows) == len(sizes)
    assert check_packing(rows) <= 1.02 * -(-sum(sizes) // 2048)
    assert packing.pack(items.limit(0), 2048).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, sport</a></li></ul></nav>
<div class="cookie-notice">We use cookies, a lot of them. Please accept.</div><article><h1>The title</h1>
<p>First <b>bold</b> paragraph,<br>with a break &amp; an entity. It goes on for a while, so that it is long.
<p>Second paragraph, unclosed.  It has   spaces. And a comparison: 1 &lt; 2.<div class="ad">Buy now!</div><p>Short.</p>
<blockquote>Quoted, too. It is a long quotation, which belongs to the text.</blockquote></article>
<aside>Related: other, stories.</aside><section id="comments"><p>First! I am a reader, and I comment at great length, on and on.</p></section>
<form><label>Mail</label><input name=q></form><footer>&copy; us</footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "The title",
        "First bold paragraph, with a break & an entity. It goes on for a while, so that it is long.",
        "Second paragraph, unclosed. It has spaces. And a comparison: 1 < 2.",
        "Short.",
        "Quoted, too. It is a long quotation, which belongs to the text.",
    ]


PROSE = "This is a long sentence, with commas, which goes on for a while. "


@pytest.mark.parametrize("tag", ["section", "div", "ul", "table"])
def test_main_text_beside_the_largest_part(tag):
    """What is selected beside one element with most of the text stays."""
    cell = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "<p>{}</p>")
    parts = [f"{i} " + PROSE * 3 for i in range(12)]
    intro, other = "Intro. " + PROSE * 3, "Other. " + PROSE * 3
    page = f"<body><nav>menu</nav><article><h1>Head</h1><p>{intro}</p><{tag}>{''.join(cell.format(x) for x in parts)}</{tag}><section><p>{other}</p></section></article></body>"
    assert html_text.main_text(page).split("\n") == [x.strip() for x in ("Head", intro, *parts, other)]


@pytest.mark.parametrize(
    "wrapper",
    ['div class="wrapper no-sidebar"', 'div class="with-sidebar"', 'div id="header-fixed"', 'div class="has-side"', 'div class="post comments-open"', 'form id="f"', "header", "aside", "fieldset", 'div role="form"'],
)
def test_main_text_in_a_wrapper_with_a_hint(wrapper):
    paragraphs = [f"{i} " + PROSE * 3 for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    want = ["Head", *(x.strip() for x in paragraphs)]
    inner = f'<{wrapper}><nav>menu</nav><h1>Head</h1>{body}<div class="related"><p>{PROSE}</p></div></{wrapper.split()[0]}>'
    assert html_text.main_text(f"<body>{inner}</body>").split("\n") == want
    comments = f'<section id="comments"><p>{PROSE}</p></section>'
    got = html_text.main_text(f"<body><p>Skip to content</p>{inner}{comments}</body>").split("\n")
    assert [x for x in got if x != "Skip to content"] == want
    span = f'<body><p>Start <b class="share">{PROSE * 3}</b> end.</p></body>'
    assert html_text.main_text(span) == f"Start {(PROSE * 3).strip()} end."


def test_main_text_of_broken_pages():
    for page in ("", "<p", "<script>x", "<!-- x", "<nav>menu</nav>", "<p></p>", "</div></p>", "<a b='>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("1 < 2") == "1 < 2"
    assert html_text.main_text("<p>" * 3000 + "deep, text.") == "deep, text."
    assert html_text.main_text("<div>" * 3000 + "deep, text.") == "deep, text."


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, None)], "page_id long, url string, html string, text int")
    rows = html_text.extract_pages(pages).collect()
    assert sorted(r["n_chars"] for r in rows) == sorted([0, *[len(html_text.main_text(PAGE))] * 2])
    assert html_text.extract_pages(pages.limit(0)).count() == 0
