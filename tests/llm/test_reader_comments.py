"""What readers write under an article goes, whatever its elements are called: leak and loss over made-up pages."""

import random

import pytest

from archlens.llm import html

WORDS = "the of river old house wind seven light carry over market train early snow paper along bridge north small window letter road under table green stone".split()
NAMES = ["Ann", "Bo Lee", "C. Diaz", "user81", "Eve"]
DATES = ["3 days ago", "12:40", "May 4, 2021", "2 hours ago", "Reply", "wrote"]


def sentences(rng, n):
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(6, 16))).capitalize() + (", " + rng.choice(WORDS) if rng.random() < 0.4 else "") + "." for _ in range(n))


def a_page(rng):
    """(html, paragraphs of the article, paragraphs of readers); classes are made up, so that none is in any list."""
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    own = [sentences(rng, rng.randint(2, 6)) for _ in range(rng.randint(3, 8))]
    said = [sentences(rng, rng.randint(1, 3)) for _ in range(rng.randint(2, 5))]
    body = f"<h1>{sentences(rng, 1)}</h1>" + "".join(f"<p>{p}</p>" for p in own)
    item, tag = name(), rng.choice(["div", "li"])
    byline = lambda: f"<{rng.choice(['div', 'p', 'h4'])}>{rng.choice(NAMES)} {rng.choice(DATES)}"
    group = "".join(f"<{tag} class={item}>{byline()}<p>{p}</p></{tag}>" for p in said)
    group = f"<{'ul' if tag == 'li' else 'div'} class={name()}>{group}</{'ul' if tag == 'li' else 'div'}>"
    shape = rng.randrange(5)
    if shape == 0:
        text = f"<article>{body}</article>{group}"
    elif shape == 1:
        text = f"<main><article>{body}</article>{group}</main>"
    elif shape == 2:
        text = f"<main>{body}{group}</main>"
    elif shape == 3:
        text = f"<div class={name()}><div class={name()}>{body}</div>{group}</div>"
    else:
        text = f"<article>{body}" + "".join(f"<article><p>{p}</p></article>" for p in said) + "</article>"
    return f"<html><body><nav><a href=/>Home</a></nav>{text}<footer>F</footer></body></html>", own, said


def test_leak_and_loss():
    rng, leaked, lost, total, readers = random.Random(3), 0, 0, 0, 0
    for _ in range(400):
        page, own, said = a_page(rng)
        kept = html.main_text(page).split("\n")
        lost += sum(len(p) for p in own if p not in kept)
        leaked += sum(len(p) for p in said if p in kept)
        total, readers = total + sum(map(len, own)), readers + sum(map(len, said))
    print(f"lost {lost / total:.4f}, leaked {leaked / readers:.4f}")
    assert lost <= 0.01 * total and leaked <= 0.05 * readers


@pytest.mark.parametrize("name", ["comments", "reader-comments", "user-comments", "comment-body", "comment-thread", "commentlist", "discussion", "zqx"])
def test_comments_behind_an_article(name):
    page = f"<article><h1>Head</h1><p>{'A sentence of the article, with a comma. ' * 5}</p></article><div class='{name}'><p>I read this with joy, and thank you for it. There should be more of them.</p></div>"
    assert "joy" not in html.main_text(page) and html.main_text(page).startswith("Head\nA sentence")


def test_adverts_within_an_article():
    page = "<article><p>A sentence of the article, with a comma. And one more of them.</p><div class='ad-slot'><p>Buy it now, and save a lot. Only today.</p></div><p>The article goes on, for a while at least.</p></article>"
    assert "Buy" not in html.main_text(page) and "goes on" in html.main_text(page)


@pytest.mark.parametrize("attributes", ["class='content has-comments'", "class='post comments-open'", "class='entry no-discussion'"])
def test_words_that_only_tell_of_comments(attributes):
    page = f"<div {attributes}><p>{'A sentence of the article, with a comma. ' * 5}</p></div>"
    assert html.main_text(page)


def test_dated_entries_of_the_article_itself_stay():
    entries = "".join(f"<div class=e><h3>{h}:30</h3><p>{'What took place at this time, and why it did. ' * 4}</p></div>" for h in range(9, 13))
    kept = html.main_text(f"<article><h1>A day</h1>{entries}</article>")
    assert kept.count("took place") == 16
