"""Pages of layouts that the fit has not seen: odd attributes, unclosed elements, and parts without telling names."""

import random

import pytest

from foliant.llm import html_tree

TEXT = "The river ran low that summer, and people of the town came to see what was left of it. They stood on the bank for hours."


@pytest.fixture(scope="module")
def model():
    return html_tree.default_model()


def main(model, page):
    return html_tree.main_texts([page], model)[0].split("\n")


def test_hidden_is_an_attribute_of_its_own(model):
    assert main(model, f"<body><article title='the hidden = truth' data-x=\"display:none\"><p>{TEXT}</p></article></body>") == [TEXT]
    for mark in ("hidden", "HIDDEN=''", "style='color:red; display : none'", 'aria-hidden="true"'):
        assert main(model, f"<body><article><p>{TEXT}</p><div {mark}><p>Not shown at all. Never.</p></div></article></body>") == [TEXT]
    assert html_tree.attributes_of(" a=1 B='x y' hidden c = \"q\" a=2/") == {"a": "1", "b": "x y", "hidden": "", "c": "q"}


@pytest.mark.parametrize("tag", ["video", "canvas", "object", "svg", "noscript", "audio", "math", "iframe", "template"])
def test_an_unclosed_element_drops_nothing(model, tag):
    page = f"<body><article><h1>Title</h1><p>{TEXT}</p><{tag} src=x><p>{TEXT} More.</p><div><{tag}><b>inner text</b></{tag}></div><p>{TEXT} End.</p></article><footer>© 2020 Someone</footer></body>"
    assert main(model, page) == ["Title", TEXT, f"{TEXT} More.", f"{TEXT} End."]


def test_raw_elements_take_time_by_their_number(model):
    page = "<article>" + "<svg><video>" * 30_000 + f"<p>{TEXT}</p></article>"
    assert TEXT in "".join(main(model, page))


def test_notice_and_comments_without_names(model):
    page = f"<body><div><div>We use cookies to make this site better for you. <button>OK</button></div><div><h1>Title here</h1><div>{TEXT}</div><div>{TEXT} Again.</div></div></div></body>"
    assert main(model, page) == ["Title here", TEXT, f"{TEXT} Again."]
    for opening in ("<section class='thread'>", "<section>", "<div class='x9'>"):
        page = f"<body><main><h1>Title here</h1><p>{TEXT}</p><p>{TEXT} Twice.</p>{opening}<h3>3 comments</h3><div><p>I disagree with all of this. It is not so.</p></div><div><p>Well said, I think the same as you do.</p></div></{'section' if 'section' in opening else 'div'}></main></body>"
        assert main(model, page) == ["Title here", TEXT, f"{TEXT} Twice."]


def test_words_of_an_article_are_no_notice(model):
    texts = ["The recipe makes thirty cookies, and the oven must be hot before they go in. Let them cool for an hour.", "Popular opinion held that the bridge would never be built. It was built all the same.", "By the time they reached the share of the road that was open, it was night. They slept there."]
    page = "<body><article><h1>Kitchen notes of a traveller</h1>" + "".join(f"<p>{t}</p>" for t in texts) + "</article></body>"
    assert main(model, page) == ["Kitchen notes of a traveller", *texts]


_WORDS = "river town people summer bridge road house evening letter window garden winter morning harbour ship captain market square church tower field horse mountain valley forest village school teacher book story music song light shadow stone wall".split()


class Layout:
    """A page of div and section elements only, whose names tell nothing, in another way than the sample pages are made."""

    def __init__(self, seed):
        self.r, self.labels, self.n = random.Random(seed), {}, 0

    def say(self, text, label):
        self.n += 1
        text = f"{text} {self.n}x" if label is None else text
        self.labels[text] = label or 0
        return text

    def sentences(self, label, least, most):
        self.n += 1
        text = " ".join(" ".join(self.r.choices(_WORDS, k=self.r.randint(6, 16))).capitalize() + "." for _ in range(self.r.randint(least, most)))
        text = f"{text} Number {self.n}."
        self.labels[text] = label
        return text

    def box(self, inner):
        return f"<div{self.r.choice(['', ' class=c1', ' class=\"sc-a1b2\"', ' id=x7'])}>{inner}</div>"

    def article(self):
        title = " ".join(self.r.choices(_WORDS, k=self.r.randint(3, 7))).capitalize() + f" {self.n}"
        self.labels[title] = 1
        parts = [f"<h1>{title}</h1>"]
        for _ in range(self.r.randint(3, 8)):
            parts.append(self.r.choice(["<p>{}</p>", "<div>{}</div>", "<div><span>{}</span></div>"]).format(self.sentences(1, 2, 5)))
        return self.box("".join(parts))

    def links(self, k, wrap="{}"):
        return "".join(wrap.format(f"<a href=/{i}>{self.say(' '.join(self.r.choices(_WORDS, k=2)).capitalize(), None)}</a>") for i in range(k))

    def page(self):
        r = self.r
        top = [self.box(self.links(5, "<div>{}</div>")), self.box(f"{self.say('This website uses cookies to see who visits it.', 0)} <button>{self.say('Accept all', 0)}</button>")]
        side = [self.box(f"<h3>{self.say('Related articles', 0)}</h3>" + self.links(4, "<div>{}</div>")), self.box(f"<p>{self.say('Subscribe to our newsletter', 0)}</p><input><button>{self.say('Go', 0)}</button>"), self.box(f"<p>{self.say('Advertisement', 0)}</p><p>{self.sentences(0, 1, 1)}</p>")]
        replies = self.box(f"<h3>{self.say(f'{r.randint(2, 40)} comments', 0)}</h3>" + "".join(self.box(f"<p>{self.sentences(0, 1, 2)}</p>") for _ in range(r.randint(1, 4))))
        foot = self.box(f"{self.say('© 2023 The Harbour Post. All rights reserved.', 0)}")
        parts = [x for x in top if r.random() < 0.7] + [self.article()] + [x for x in [replies, *side] if r.random() < 0.6] + [foot]
        return f"<html><body>{self.box(''.join(parts)) if r.random() < 0.5 else ''.join(parts)}</body></html>"


def test_nameless_layouts(model):
    right = total = 0
    for seed in range(80):
        layout = Layout(seed)
        page = html_tree.Page(layout.page())
        (chance,) = model.marginals([page])
        for text, tag, p in zip(page.text, page.tag, chance, strict=True):
            if tag == "#text":
                total += 1
                right += (p >= 0.5) == bool(layout.labels[text])
    assert total > 1000 and right / total > 0.95
