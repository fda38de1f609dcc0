"""Block rules: layouts, marked and unmarked pages, and the second pass against its definition."""

import html
import random
import re

import pandas as pd
import pytest

from lacuna.llm import html_text as ht

PROSE = "<p>This is the story of a man who was in the town and of the people that he met there on his way.</p><p>Short.</p>"
ARTICLE = f"<article><h1>Title</h1>{PROSE}<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul></article>"
COMMENTS = "<div class=comments><p>I like the story of the man and of his way to the town there, and so will you.</p><article>Nice and good</article></div>"
TEXT = "Title\nThis is the story of a man who was in the town and of the people that he met there on his way.\nShort.\nSource one\nSource two"


@pytest.mark.parametrize("name", ["page-has-sidebar", "layout sidebar-right", "nav-open", "wrapper modal-enabled", "post-with-comments", "main-menu-layout"])
def test_a_layout_is_not_furniture(name):
    assert ht.main_text(f"<body><div class='{name}'><nav><a href=x>x</a></nav>{ARTICLE}<aside>More of the same</aside>{COMMENTS}</div><footer>f</footer>") == TEXT
    assert ht.main_text(f"<body><div class='{name}'><h2>Title</h2>{PROSE * 2}</div>").startswith("Title\nThis is")


def test_sidebars_and_comments_are_furniture():
    aside = "<div class='sidebar'><article><p>A teaser of a story that is told in the next part of the site.</p></article></div>"
    assert ht.main_text(f"<body>{aside}<main>{ARTICLE}</main>{COMMENTS}") == TEXT
    assert ht.main_text(f"<body><h2>Title</h2>{PROSE * 3}{COMMENTS}").count("I like") == 0


def test_a_small_region_does_not_outweigh_the_page():
    page = f"<body><h1>Title</h1>{PROSE * 6}<article><p>One more thing.</p></article>"
    assert ht.main_text(page) == "\n".join(["Title", *[x[3:-4] for x in re.findall("<p>.*?</p>", PROSE)] * 6, "One more thing."])


def article_of(page):
    """The article of a page of the test tables, by plain splitting."""
    inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", page, re.DOTALL)[1]).replace("<br>", " ")
    return "\n".join(x for part in re.split("</?(?:p|h1)>", inner) if (x := " ".join(html.unescape(part).split())))


def test_pages_with_and_without_their_markup():
    """The rules find the article of 90 % of pages whose regions are plain divs without names, and of all others."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]
    assert all(ht.main_text(p) == article_of(p) for p in pages)
    bare = [re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|aside|footer|header|section)\b[^>]*>", r"<\1div>", p)) for p in pages]
    assert sum(ht.main_text(b) == article_of(p) for b, p in zip(bare, pages, strict=True)) >= 0.9 * len(pages)


def by_definition(blocks, labels):
    """For each ambiguous block, look at all blocks for the nearest decided ones."""
    region = [b.region if b.place == ht.Place.CONTENT else 0 for b in blocks]
    out = []
    for k, b in enumerate(blocks):
        peers = [j for j in range(len(blocks)) if region[j] == region[k] and labels[j] is not None and not ht.is_rights(blocks[j])]
        if labels[k] is not None:
            out.append(labels[k])
        elif not peers or True not in labels:
            out.append(True)
        elif b.heading and any(j > k for j in peers):
            out.append(labels[min(j for j in peers if j > k)])
        else:
            least = min(abs(j - k) for j in peers)
            out.append(any(labels[j] for j in peers if abs(j - k) == least))
    return out


def test_second_pass_equals_its_definition():
    rng = random.Random(4)
    for _ in range(500):
        blocks = []
        for _ in range(rng.randint(0, 14)):
            place = rng.choice(list(ht.Place))
            blocks.append(ht.Block(region=rng.randint(1, 2) if place == ht.Place.CONTENT else 0, heading=rng.random() < 0.2, text=rng.choice(["x", "x", "© x"]), place=place))
        labels = [rng.choice([True, False, None, None]) for _ in blocks]
        assert ht.second_pass(blocks, labels) == by_definition(blocks, labels)


RUSSIAN = "Старый город стоит на берегу широкой реки. Каждое утро рыбаки выходят на лодках, и дети смотрят им вслед с высокого моста. Вечером они возвращаются домой с уловом. Так проходит каждый день короткого северного лета, пока не приходят холода."
TURKISH = "Eski şehir geniş bir nehrin kıyısında durur. Her sabah balıkçılar teknelerle denize çıkar, çocuklar yüksek köprüden onlara bakar. Akşam olunca hepsi evlerine döner. Kısa kuzey yazının günleri soğuklar gelene kadar böyle geçer, sonra nehir donar."
FINNISH = "Vanha kaupunki seisoo leveän joen rannalla. Joka aamu kalastajat lähtevät veneillä vesille, ja lapset katselevat heitä korkealta sillalta. Illalla he palaavat kotiin saaliin kanssa. Näin kuluu jokainen lyhyen pohjoisen kesän päivä, kunnes pakkaset tulevat."
CHINESE = "老城坐落在一条大河的岸边。每天早晨,渔夫们划着小船出去捕鱼,孩子们站在高高的桥上望着他们。傍晚,他们带着收获回到家里。北方短暂的夏天就这样一天一天地过去,直到寒冷来临,河水结冰。"


@pytest.mark.parametrize("prose", [RUSSIAN, TURKISH, FINNISH, CHINESE])
def test_any_language_with_and_without_regions(prose):
    """Two paragraphs between navigation, a button and a note of rights; links and lists of words stay furniture."""
    nav = "<div><a href=a>Home</a> <a href=b>News</a> <a href=c>Weather</a></div>"
    foot = "<div>© 2024 the owners</div>"
    for page in (f"<body>{nav}<article><p>{prose}</p><p>{prose}</p></article>{foot}", f"<body>{nav}<div><p>{prose}</p><p>{prose}</p></div>{foot}"):
        assert ht.main_text(page) == f"{prose}\n{prose}"
    assert "Sport" not in ht.main_text(f"<body>{nav}<div>{'Sport Politik Wetter Kultur Reise ' * 8}</div><div><p>{prose}</p><p>{prose}</p></div>{foot}")


@pytest.mark.parametrize("name", ["social-history", "comments-on-law", "share-prices", "related-work", "banner-image", "notice-of-death", "footer-note", "menu-items", "widget-list"])
def test_an_articles_own_subject_is_not_furniture(name):
    inner = f"<div class='{name}'><h2>Part</h2>{PROSE}</div>"
    assert ht.main_text(f"<body><nav>n</nav><article><h1>Title</h1>{PROSE}{inner}</article>") == "\n".join(["Title", TEXT.split("\n")[1], "Short.", "Part", TEXT.split("\n")[1], "Short."])


@pytest.mark.parametrize("name", ["comments", "comment-box", "comments-section", "reader-comments", "ad", "ad-slot-3", "google-ads", "newsletter-box", "related-posts", "cookie-banner", "social-share", "promo", "advert_container"])
def test_adverts_and_comments_go_from_inside_an_article(name):
    assert ht.main_text(f"<body><article><h1>Title</h1>{PROSE}<div class='{name}'>{PROSE}</div></article>") == "\n".join(TEXT.split("\n")[:3])


def test_links_under_a_doubtful_name_go():
    links = "".join(f"<li><a href=x>Another page of the site {k}</a></li>" for k in range(5))
    assert ht.main_text(f"<body><article><h1>Title</h1>{PROSE}<div class='menu-items'><ul>{links}</ul></div></article>") == "\n".join(TEXT.split("\n")[:3])


def test_formulas_keep_their_text():
    assert ht.main_text("<article><p>We get <math><mi>E</mi><annotation encoding='t'>\\E</annotation></math> at once.</p></article>") == "We get E at once."


@pytest.mark.parametrize(
    ("text", "links", "place", "label"),
    [
        ("word " * 60, 0, ht.Place.PLAIN, False), ("the word " * 40, 0, ht.Place.PLAIN, True), ("the word", 0, ht.Place.PLAIN, None), ("the word " * 40, 300, ht.Place.PLAIN, False),
        ("word " * 60, 0, ht.Place.CONTENT, None), ("the word " * 40, 300, ht.Place.CONTENT, None), ("the word " * 40, 0, ht.Place.OUTSIDE, False), ("the word " * 40, 0, ht.Place.FURNITURE, False),
        ("© the word", 0, ht.Place.PLAIN, False),
    ],
)
def test_first_pass(text, links, place, label):
    assert ht.first_pass(ht.Block(text=text, link_chars=links, place=place)) is label
