import pytest

from svcops.llm import html_text as H

STOP = frozenset("the of and".split())
LONG = ("the quick of and " * 20).strip()


@pytest.mark.parametrize("page, text", [
    (f"<div class='post'><h2>Teaser</h2></div><div><p>{LONG}</p><p>short tail</p></div><nav>Home</nav>", f"Teaser\n{LONG}\nshort tail"),
    (f"<section class='entry'><h1>Headline</h1></section><div>{LONG}</div><div class=comments>{LONG}</div>", f"Headline\n{LONG}"),
    (f"<div>{LONG}</div><article><h3>Card</h3></article><article><a href=1>Other card</a></article>", f"{LONG}\nCard"),
    (f"<article><p>x</p></article><div>tail</div><div><a href=1>{LONG}</a></div>", "x"),
    (f"<div id=content><p>{LONG}</p><div><a href=1>Home</a></div><div>Login</div><div><a href=2>About</a></div></div>", LONG),
    (f"<div><div><a href=1>Home</a></div><p>{LONG}</p><p>short</p></div>", f"{LONG}\nshort"),
])
def test_containers_are_only_evidence(page, text):
    assert H.main_text(page, STOP) == text
