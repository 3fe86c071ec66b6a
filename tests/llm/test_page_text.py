"""Inside an article only noise is dropped."""

from cueweave.llm.page_text import main_text


def para(n, letter):
    return f"<p>{letter * (n - 1)}.</p>"


def test_table_list_figure_and_title_of_an_article_stay():
    html = ("<body><nav><a href=x>Home</a></nav><div><p>ad</p></div><article><div><h1>Title</h1></div>" + para(300, "a") + para(400, "b")
            + "<table><tr><td>r1c1</td><td>r1c2xx</td></tr><tr><td>r2c1x</td><td>r2c2xxx</td></tr></table>" + para(350, "c")
            + "<section><ul><li>one</li><li>two</li><li>three</li></ul></section>" + para(350, "d")
            + "<figure><img src=x><figcaption>Fig</figcaption></figure>" + para(350, "e")
            + "<div class='share'>Share this</div></article><footer>Foot</footer></body>")
    blocks = main_text(html).split("\n\n")
    short = [b for b in blocks if len(b) < 100]
    assert short == ["Title", "r1c1", "r1c2xx", "r2c1x", "r2c2xxx", "one", "two", "three", "Fig"]
    assert len(blocks) == len(short) + 5


def test_formulas_objects_and_labels_of_an_article_stay():
    html = ("<article>" + para(200, "a") + "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>"
            "<object data=x>fallback</object><p><label>Note</label> this</p></article>")
    assert main_text(html).split("\n\n")[1:] == ["so x=1 holds", "fallback", "Note this"]
    assert "Name" not in main_text("<body><label>Name</label>" + para(200, "a") + "</body>")
