"""Main text in other languages, and in wrappers whose class only mentions noise."""

from loomweb.llm.htmltext import main_text

ENGLISH = "The scope of the work that we do is set out in this text, and it is for all of the people who have read it with care. " * 3
POLISH = "Wczoraj rano pociąg przyjechał punktualnie, lecz pasażerowie czekali jeszcze długo przed zamkniętym dworcem kolejowym. " * 3
RUSSIAN = "Вчера утром поезд прибыл вовремя, однако пассажиры ещё долго ждали перед закрытым зданием железнодорожного вокзала. " * 3
CHINESE = "昨天早上火车准时到达，但是乘客们仍然在关闭的车站大楼前等待了很长时间。" * 8


def page(inner):
    return f"<html><body><div class='menu'><a href='/'>Home</a></div>{inner}<div class='site-footer'>{ENGLISH}</div></body></html>"


def test_other_languages():
    for t in (POLISH, RUSSIAN, CHINESE):
        got = main_text(page(f"<div><h1>Head</h1><p>{t}</p><p>{t[:90]}</p></div>"))
        assert t.strip() in got and t[:90].strip() in got.split("\n") and "scope" not in got and "Home" not in got


def test_wrappers_named_after_noise():
    for c in ("content-sidebar-wrap", "post no-sidebar", "with-sidebar", "content has-menu"):
        assert main_text(page(f"<div class='{c}'><p>{ENGLISH}</p></div>")) == ENGLISH.strip()
    for tag in ("main", "article"):
        got = main_text(page(f"<div class='sidebar-left'><h2>Before</h2><{tag}><p>{ENGLISH}</p></{tag}></div>"))
        assert ENGLISH.strip() in got.split("\n") and "Home" not in got


def test_noise_stays_noise():
    short = "<p>Little text here.</p>"
    related = f"<div class='related-posts'><article><p>{ENGLISH}</p></article></div>"
    assert "scope" not in main_text(page(f"<article><p>{RUSSIAN}</p></article>{related}"))
    assert "scope" not in main_text(page(f"<div>{short}<p>{RUSSIAN}</p><p>{RUSSIAN}</p></div>{related}"))
