"""Ordinary markup that must not swallow a page, and token ids of odd Unicode against the tokenizer itself."""

import random

import numpy as np
import pytest

from probity.llm import html_text, packing

BODY = "<p>The committee met on Tuesday and agreed to repair the old bridge before winter comes.</p><p>Work begins in May and will last for about six weeks.</p>"
TEXT = ["The committee met on Tuesday and agreed to repair the old bridge before winter comes.", "Work begins in May and will last for about six weeks."]


def text(page):
    return html_text.main_text(page, {})


@pytest.mark.parametrize("before", [
    "<script>for(var i=0;i<n;i++){f(i)}</script>",
    "<script>var s='<!--';</script>",
    "<script>if (a<b && c<d) { document.write('<div class=\"ad\">') }</script>",
    "<style>/* a <b of sorts */ p { color: red }</style>",
    "<SCRIPT>x<y</SCRIPT >",
    "<svg><path d='M0 0'></svg>",
    "<textarea>a <b c</textarea>",
    "<noscript><img src=x></noscript>",
    "<script src=x></script>",
    "<svg viewBox='0 0 1 1'/>",
    "<template><p>not shown</template>",
    "<!-- <script> -->",
    "<canvas>",
])
def test_raw_text_ends_at_its_own_tag(before):
    for page in (f"<html><body>{before}{BODY}</body></html>", f"<html><body>{BODY.replace('</p><p>', '</p>' + before + '<p>')}</body></html>"):
        assert text(page).split("\n\n") == TEXT


def test_a_head_without_its_end_tag():
    assert text(f"<html><head><title>News</title><meta charset=utf-8><body>{BODY}</body></html>").split("\n\n") == TEXT
    assert text(f"<html><head><title>News</title><link rel=x href=y>{BODY}").split("\n\n") == TEXT


def test_mathematics_and_signs_stay_in_the_text():
    assert text("<p>Here <math><mi>x</mi></math> is big enough for all of us to see it well.</p>") == "Here x is big enough for all of us to see it well."
    assert text("<p>So if a<b then we say that a is the smaller one of the two.</p>") == "So if a<b then we say that a is the smaller one of the two."
    assert text("<p>We know that 3 < 5 and that 5 > 3 and also that i<n; in loops like these.</p>") == "We know that 3 < 5 and that 5 > 3 and also that i<n; in loops like these."


def test_an_open_script_lasts_to_the_end():
    assert text(f"<body>{BODY}<script>var a = 1 <p>never shown").split("\n\n") == TEXT


def plain_ids(tokenizer, t):
    return tokenizer.tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_of_odd_words_equal_the_tokenizers():
    t = packing.ChunkTokenizer(packing.default_vocabulary())
    rng = random.Random(4)
    letters = "aAzZéÉßİıŞñçœŒÅΩςΣйЙ中ｱﬁªǅʼnª٣5_-'’́̇‍\U0001F600"
    words = ["DİYARBAKİ,", "İ.", "İ!", "é,", "É;", "Σ.", "ß?", "ǅ:", "ﬁ,", "ªª.", "5,", "_.", "..", ",", "A", "á,"]
    words += ["".join(rng.choices(letters, k=rng.randint(1, 6))) + rng.choice(["", ".", ",", ";", ":", "!", "?", "?!"]) for _ in range(6_000)]
    rng.shuffle(words)
    texts = [" ".join(words[i:i + 7]) for i in range(0, len(words), 7)] + words[:2_000]
    for text_, ids in zip(texts, t.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain_ids(t, text_), text_


def test_a_vocabulary_that_keeps_case_is_not_folded():
    t = packing.ChunkTokenizer.__new__(packing.ChunkTokenizer)
    t.store, t.normal, t.folds, seen = {}, str, False, []
    t._ids = lambda xs: [seen.extend(xs) or b"" for _ in xs][:len(xs)]
    t._learn({"Word,"})
    assert "Word" in seen and "word" not in seen
