"""Pages as nodes; roles, names, states, structure and outline."""

import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from hushframe.functions.materialize import materialized
from hushframe.operators import fields, identify, nodes, outline, redact
from hushframe.sources import pages as source
from hushframe.sources import tables

HTML = """<!DOCTYPE html><html><head><title> My  page </title><script>var a = "<p>";</script></head><body>
<nav aria-label="Main"><ul><li><a href="/a">One<li><a href="/b" title="t">Two <b>bold</b></a></ul></nav>
<p>First paragraph<p>Second paragraph with ravi@example.com<br>inside
<form><label for="em">E mail</label><input id="em" type="email" value="ravi@example.com">
<label>Wrapped <input name="firstName" value="Ravi"></label><input type="checkbox" checked aria-label="Agree">
<input type="search" placeholder="Find it"><input type="submit" value="Send it"><textarea id="notes">call 98765 43210</textarea>
<select><option>One<option selected>Two</select></form>
<div role="search" tabindex="0" aria-label="Search"><button aria-label="Search" aria-expanded="false">go</button></div>
<a href="/c"><span tabindex="0">Inner</span></a><div style="opacity:0"><a href="/hidden">Hidden</a></div><div style="display:none">x</div>
<span id="l1">Alpha</span><span id="l2">Beta</span><button aria-labelledby="l2 l1 nope"></button>
<div><template shadowrootmode="open"><button>Shadow</button></template></div><template><p>never</p></template>
<iframe src="https://ads.example.com/x?y=1"></iframe><frame title=" Side "><img alt="" src="x"><div class="icon-search"></div>
</body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(1, "https://h.example.com/p?q=1", HTML), (2, "about:blank", None), (3, "", "")], "page_id long, url string, html string")
    return source.page_nodes(pages).cache()


def tags(df):
    return [r["tag"] for r in df.orderBy("pos").collect()]


def test_nodes(rows):
    got = tags(rows)
    assert got.count("p") == 2 and got.count("li") == 2 and "script" not in got and "template" not in got and "br" not in got
    shadow = rows.where("shadow").collect()
    assert [r["inline_text"] for r in shadow] == ["Shadow"]
    got = {r["node_id"]: r for r in rows.collect()}
    for r in got.values():
        above = []
        while (up := (above[-1] if above else r)["parent_id"]) is not None:
            above.append(got[up])
        assert r["depth"] == len(above) and all(a["node_id"] < r["node_id"] <= a["last"] for a in above)
        assert sum(a["node_id"] < r["node_id"] <= a["last"] for a in got.values()) == len(above)
        assert r["select_id"] == next((a["node_id"] for a in above if a["tag"] == "select"), None)


def test_text_nodes_header_links_frames(spark, rows):
    texts = [r["text"] for r in source.page_text_nodes(rows).orderBy("node_id", "nth").collect()]
    assert "First paragraph" in texts and not any(len(t) < 10 for t in texts)
    assert "Second paragraph with ravi@example.com" in texts
    pages = spark.createDataFrame([(1, "https://h.example.com/p?q=1", HTML)], "page_id long, url string, html string")
    head = source.page_header(pages).first()
    assert (head["title"], head["host"]) == ("My page", "h.example.com")
    assert [r["href"] for r in source.page_links(pages).orderBy("pos").collect()][-2:] == ["/c", "/hidden"]
    assert [r["label"] for r in source.page_frames(rows).orderBy("node_id").collect()] == ["ads.example.com", "Side"]


def test_text_nodes_are_apart(spark):
    """A break, an inline child or a comment parts two text nodes: nothing is found across, nothing is hidden by what follows."""
    html = "<p>write to user@example.com<br>next line</p><p>98765<b>x</b>43210</p><p>98765<!-- c -->43210</p><p>call 98765 43210 now</p><p>a &lt; b, said info@example.org</p>"
    pages = spark.createDataFrame([(1, "", html)], "page_id long, url string, html string")
    texts = source.page_text_nodes(source.page_nodes(pages), min_len=1)
    assert [r["text"] for r in texts.orderBy("node_id", "nth").collect()] == ["write to user@example.com", "next line", "98765", "43210", "x", "98765", "43210", "call 98765 43210 now", "a < b, said info@example.org"]
    found = {(r["kind"], r["start"], r["end"]) for r in identify.find_in_pages(texts).collect()}
    assert found == {("email", 9, 25), ("tel", 5, 16), ("email", 12, 28)}
    many = "<p>" + "<br>".join(f"mail user{i}@example.com today" for i in range(5000)) + "</p>"
    pages = spark.createDataFrame([(1, "", many)], "page_id long, url string, html string")
    assert identify.find_in_pages(source.page_text_nodes(source.page_nodes(pages))).count() == 5000


def test_unclosed_tags_take_linear_time():
    began = time.time()
    found = source.parsed("<div>text " * 20000)
    assert len(found) == 20000 and max(r["depth"] for r in found) == 19999 and time.time() - began < 20
    assert len(source.parsed("<b>x" * 20000)) == 20000 and time.time() - began < 40
    assert len(source.parsed("<b><p>x" * 5000 + "</i>" * 50000)) == 10000 and time.time() - began < 60


def test_names_are_whole(spark):
    long = "word " * 4000
    html = f"<button>{long}a@example.com</button><label>{long}<input></label><div tabindex=0><h1>{long}</h1></div><i id=x><p>{long}</p>end</i><a href=/q aria-labelledby=x></a>"
    rows = source.page_nodes(spark.createDataFrame([(1, "", html)], "page_id long, url string, html string"))
    named = {r["tag"]: r["name"] for r in nodes.node_name(rows).collect()}
    assert named["button"] == long + "a@example.com" and named["input"] == named["div"] == long.strip() and named["a"] == "end"
    assert "a@example.com" not in redact.redact_names(nodes.node_name(rows)).where("tag = 'button'").first()["name"]


def by_name(rows):
    return nodes.node_name(nodes.node_role(rows))


def test_names_and_roles(rows):
    named = {(r["tag"], r["role"], r["name"]) for r in by_name(rows).collect()}
    for want in [
        ("input", "textbox", "E mail"), ("input", "checkbox", "Agree"), ("input", "searchbox", "Find it"), ("input", "button", "Send it"), ("a", "link", "t"),
        ("button", "button", "Beta Alpha"), ("div", "search", "Search"), ("nav", "navigation", "Main"), ("img", "presentation", ""),
    ]:
        assert want in named, want


def test_values_and_states(rows):
    valued = nodes.node_states(redact.redact_values(nodes.node_sensitive(nodes.node_value(rows))))
    states = {(r["tag"], (r["attrs"].get("id") or r["attrs"].get("type") or r["attrs"].get("name"))): r["states"] for r in valued.collect()}
    assert states["input", "em"] == ["value=[redacted:email]"]
    assert states["input", "checkbox"] == ["checked"]
    assert states["input", "firstName"] == ["value=[redacted:name]"]
    assert states["textarea", "notes"] == ['value="call [redacted:tel]"']
    assert states["select", None] == ['value="Two"']
    masked = fields.fields_to_mask(valued.withColumn("bounds", F.lit(1)))
    assert {r["kind"] for r in masked.collect()} == {"email", "name"}


def test_visible_and_predicates(rows):
    seen = nodes.node_visible(rows)
    links = [r["attrs"]["href"] for r in seen.where("tag = 'a'").orderBy("pos").collect()]
    assert links == ["/a", "/b", "/c"]
    roles = nodes.node_role(rows)
    hint = nodes.node_search_hint(roles).where("search_hint").collect()
    assert [r["attrs"].get("class") for r in hint] == ["icon-search"]
    assert nodes.node_widget_state(roles).where("widget_state").count() == 1
    assert nodes.node_focusable(roles).where("focusable and tag = 'span'").count() == 1
    assert nodes.node_interactive(roles).where("interactive and tag = 'p'").count() == 0


def test_dominance_keeps_the_strong_control(rows):
    kept = nodes.name_dominance(nodes.candidates(rows))
    names = [(r["tag"], r["name"]) for r in kept.orderBy("pos").collect()]
    assert ("button", "Search") in names and ("a", "Inner") in names and ("span", "Inner") not in names


def test_collapse(spark):
    box = lambda n, last, strong, link, x, w: (1, n, last, strong, link, x, 0.0, w, 10.0)
    made = [box(1, 5, False, False, 0.0, 100.0), box(2, 5, False, False, 1.0, 98.0), box(3, 5, True, True, 1.0, 98.0), box(4, 4, False, False, 5.0, 5.0), box(5, 5, True, False, 2.0, 97.0)]
    df = spark.createDataFrame(made, "page_id long, node_id int, last int, strong_element boolean, link_or_button boolean, x double, y double, width double, height double")
    assert sorted(r["node_id"] for r in nodes.collapse_wrappers(df).collect()) == [3, 5]


def test_outline(rows):
    kept = materialized(nodes.without_weak_inside(nodes.name_dominance(nodes.candidates(rows))))
    placed = materialized(nodes.attach_parents(rows, kept))
    shown = nodes.node_role(placed).join(kept.select("page_id", "node_id", F.lit(True).alias("element"), "name"), ["page_id", "node_id"], "left")
    lines = outline.element_line(nodes.node_states(nodes.node_sensitive(shown)).withColumns({"element": F.coalesce("element", F.lit(False)), "scrollable": F.lit(False)}))
    text = outline.page_outline(lines).first()["outline"].split("\n")
    assert text[0] == "nav" and text[1] == "  ul" and text[3].lstrip().startswith("[") and 'link "One"' in text[3]
    cut = outline.page_outline(lines, max_lines=3).first()["outline"]
    assert cut.endswith(f"… {len(text) - 3} more lines")
    funnel = nodes.scan_funnel(rows).first()
    assert funnel["visited"] >= funnel["interactive"] >= funnel["after_name"] >= funnel["final"] > 0


def test_bounds(spark, rows):
    boxes = [(1, 0, 0.0, 0.0, 5.0, 50.0, "static"), (1, 1, 0.0, 900.0, 50.0, 50.0, "static"), (1, 2, 0.0, 5000.0, 50.0, 50.0, "fixed"), (1, 3, 0.0, 5000.0, 50.0, 50.0, "static")]
    bounds = spark.createDataFrame(boxes, "page_id long, node_id int, x double, y double, width double, height double, position string")
    near = nodes.node_near_viewport(rows.select("page_id", "node_id"), bounds, 1280, 800)
    assert sorted(r["node_id"] for r in near.collect()) == [1, 2]
    table = rows.where("tag = 'form'").first()["node_id"]
    body = rows.where("tag = 'body'").first()["node_id"]
    metrics = spark.createDataFrame([(1, n, "auto", "visible", 500, 100, 50, 50) for n in (table, body)], "page_id long, node_id int, overflow_y string, overflow_x string, scroll_height int, client_height int, scroll_width int, client_width int")
    scrolls = nodes.node_scrollable(rows, metrics).where("scrollable")
    assert set(tags(scrolls)) <= {"form", "label", "input", "textarea", "select", "option"} and scrolls.count() > 5


def chain(spark, n, loop=False):
    """Page i embeds page i + 1, each a little further in; with ``loop`` the last embeds the first."""
    rows = [(i, 1, i + 1, 2.0, 3.0, 400.0, 300.0, 1.0, 1.0) for i in range(n)] + [(n, 1, 0, 2.0, 3.0, 400.0, 300.0, 1.0, 1.0)] * loop
    return spark.createDataFrame(rows, "page_id long, pos int, child_page_id long, x double, y double, width double, height double, border_left double, border_top double")


def test_deep_frames_take_few_rounds(spark):
    frames = chain(spark, 20)
    ways = {(r["page_id"], r["top_id"]): r for r in nodes.frame_paths(frames).collect()}
    assert set(ways) == {(i, j) for i in range(21) for j in range(i)}
    assert all(w["depth"] == i - j and w["tag"] == "f1-" * (i - j) and (w["dx"], w["dy"]) == (3.0 * (i - j), 4.0 * (i - j)) and (w["left"], w["right"]) == (2.0 + 3 * (i - j - 1), 402.0) for (i, j), w in ways.items())
    assert {(r["page_id"], r["top_id"]) for r in nodes.frame_paths(frames, max_depth=5).collect()} == {(i, j) for i, j in ways if i - j <= 5}
    looped = nodes.frame_paths(chain(spark, 3, loop=True)).collect()
    assert len(looped) == 12 and all(1 <= r["depth"] <= 3 for r in looped)
    assert nodes.frame_paths(frames.limit(0)).count() == 0


def test_names_and_regions_of_embedded_pages(spark):
    frames = chain(spark, 2)
    elements = spark.createDataFrame([(2, 1, "to [redacted:email#1] and [redacted:tel#f3-2] $1", 5.0, 5.0, 10.0, 10.0), (2, 2, "beyond", 500.0, 5.0, 10.0, 10.0), (2, 3, None, 395.0, 5.0, 50.0, 10.0)], "page_id long, element_id int, name string, x double, y double, width double, height double")
    out = {(r["page_id"], r["element_id"]): r for r in nodes.inline_frames(elements, frames).collect()}
    assert out[0, 1]["name"] == "to [redacted:email#f1-f1-1] and [redacted:tel#f1-f1-f3-2] $1" and out[1, 1]["name"].startswith("to [redacted:email#f1-1]") and out[2, 1]["name"] == elements.first()["name"]
    assert (0, 2) not in out and (1, 2) not in out and out[0, 3]["name"] is None and (out[0, 3]["x"], out[0, 3]["width"]) == (401.0, 1.0)
    regions = elements.select("page_id", F.col("element_id").alias("region_id"), F.lit("email").alias("kind"), "x", "y", "width", "height")
    assert [(r["kind"], r["depth"]) for r in nodes.inline_regions(regions, frames).where("page_id = 0").collect()] == [("email", 2)] * 2


def test_funnel_counts_are_observed(spark, rows):
    """Totals of all pages come from the rows as they pass."""
    both = rows.unionByName(rows.withColumn("page_id", F.lit(9).cast("long")))
    bounds = both.select("page_id", "node_id", F.lit(0.0).alias("x"), (F.col("node_id") * 30.0).alias("y"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h"), F.col("node_id").alias("paint_order"))
    cover = both.where("page_id = 9 and tag = 'iframe'").select("page_id", "node_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(500.0).alias("w"), F.lit(5000.0).alias("h"), F.lit(10_000).alias("paint_order"))
    bounds = bounds.join(cover.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti").union(cover)
    seen = Observation("funnel")
    counts = {r["page_id"]: r for r in nodes.scan_funnel(both, bounds, 800, 600, observation=seen).collect()}
    assert list(counts[1].asDict()) == ["page_id", *nodes.FUNNEL]
    assert all(seen.get[c] == sum(r[c] for r in counts.values()) for c in nodes.FUNNEL)
    assert counts[1]["after_occlusion"] == counts[1]["after_name"] and counts[9]["after_occlusion"] < counts[9]["after_name"] == counts[1]["after_name"]
    plain = nodes.scan_funnel(rows).first()
    assert plain["visited"] == rows.count() and plain["after_name"] == plain["after_occlusion"] >= plain["final"] > 0


def test_observation_says_what_the_browser_shows(spark):
    headers = spark.createDataFrame([(1, "https://h.example.com/?u=a@x.com", "Mail a@x.com"), (2, "about:blank", None)], "page_id long, url string, title string")
    tabs = spark.createDataFrame([(1, 7, 2, "Two", "https://two.example.com/", False), (1, 9, 1, "b@x.com", "https://one.example.com/", True), (2, 1, 1, "alone", "x", True)], "page_id long, tab_id long, pos int, title string, url string, active boolean")
    views = spark.createDataFrame([(1, 1280, 900, 0.5, -2.5)], "page_id long, width int, height int, scroll_x double, scroll_y double")
    out = {r["page_id"]: r["observation"].split("\n") for r in outline.page_observation(headers, spark.createDataFrame([(1, '[0] link "A"')], "page_id long, outline string"), tabs=tabs, viewports=views).collect()}
    assert out[1] == ["Browser state:", "Tabs:", '* [9] "[redacted:email]" https://one.example.com/', '  [7] "Two" https://two.example.com/', 'Page: "Mail [redacted:email]" — https://h.example.com/?u=[redacted:email]', "Viewport: 1280x900, scrolled to (1, -2)", "", outline.HEADING, '[0] link "A"']
    assert out[2] == ["Browser state:", 'Page: "" — about:blank', "", "The page shows no control."]


def test_frames(spark):
    elements = spark.createDataFrame([(p, e, "n", 10.0, 10.0, 30.0, 20.0) for p in (1, 2, 3) for e in (1, 2)], "page_id long, element_id int, name string, x double, y double, width double, height double")
    frames = spark.createDataFrame([(1, 1, 2, 100.0, 100.0, 200.0, 200.0, 2.0, 2.0), (1, 2, 2, 0.0, 0.0, 40.0, 40.0, 0.0, 0.0), (2, 1, 3, 5.0, 5.0, 60.0, 22.0, 0.0, 0.0), (2, 2, 3, 0.0, 0.0, 60.0, 60.0, 0.0, 0.0)], "page_id long, pos int, child_page_id long, x double, y double, width double, height double, border_left double, border_top double")
    out = nodes.inline_frames(elements, frames).where("top_id = 1").collect()
    assert sorted(r["tag"] for r in out) == ["", "", "f1-", "f1-", "f1-f1-", "f1-f1-"]
    assert {(r["x"], r["y"]) for r in out if r["tag"] == "f1-"} == {(112.0, 112.0)}


CLASSES = [
    ("input", "password", None, "", "password"), ("input", "email", None, "", "email"), ("input", "tel", None, "", "tel"),
    ("input", "text", "cc-number", "", "cc-number"), ("input", "text", "section-payment shipping cc-number", "", "cc-number"), ("input", "text", "one-time-code", "", "one-time-code"),
    ("input", "text", None, "firstName", "name"), ("input", "text", None, "dateOfBirthInput", "bday"), ("input", "text", None, "aadhaarNumber", "aadhaar"),
    ("input", "text", None, "PIN code", "postal-code"), ("input", "text", None, "E-mail", None), ("input", "search", None, "q", None), ("input", "text", None, "orderReference", None),
    ("input", "checkbox", None, "Password", None), ("div", None, None, "password", None), ("textarea", None, None, "user_phone", "tel"),
]


def test_classification(spark):
    made = [(i, t, ty, a, None, None, None, x, None) for i, (t, ty, a, x, _) in enumerate(CLASSES)]
    df = spark.createDataFrame(made, "n int, tag string, type string, autocomplete string, aria_label string, name string, placeholder string, id string, label string")
    got = [r["sensitive"] for r in fields.classify_fields(df).orderBy("n").collect()]
    assert got == [c[-1] for c in CLASSES]
    made = [("a@example.com", 1.0, "9876543210", 7, None), ("b@example.com", 2.0, "none", 8, None), (None, 3.0, "also none", 9, None)]
    columns = fields.classify_columns(spark.createDataFrame(made, "contact string, c_acctbal double, phoneNumber string, id long, tags array<string>"))
    assert {tuple(r) for r in columns.collect()} == {("contact", None, "email", 2, 2), ("phoneNumber", "tel", None, 3, 1), ("c_acctbal", None, None, 3, 0), ("id", None, None, 3, 0)}


def test_truth_markup(spark):
    pages = spark.createDataFrame([(1, "", '<p><span data-pii="pan">ABCPE1234F</span> for <em class="x" data-decoy="price">450</em></p>')], "page_id long, url string, html string")
    assert [tuple(r) for r in tables.src_truth(pages).collect()] == [(1, "pan", None, "ABCPE1234F"), (1, None, "price", "450")]


def test_wrappers_collapse_in_one_pass_over_many_pages(spark):
    """Pages go on from batch to batch, one is larger than a batch, and none is a Python call of its own."""
    rows = spark.range(60).selectExpr("id as page_id", "explode(sequence(0, if(id = 7, 25001, 3))) as node_id")
    rows = rows.selectExpr("page_id", "node_id", "node_id div 2 * 2 + 1 as last", "node_id % 2 = 1 as strong_element", "node_id % 4 = 0 as link_or_button", "0.0D as x", "0.0D as y", "10.0D as width", "10.0D as height")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    out = nodes.collapse_wrappers(rows)
    left = {(r["page_id"], r["node_id"]) for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Of each pair the weak outer one goes.
    assert left == {(p, n) for p in range(60) for n in range(1, 25002 if p == 7 else 4, 2)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
