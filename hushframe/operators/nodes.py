"""Node rows: roles, names, states, and which nodes are controls worth keeping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_one_of, lit_array, squash, truncated
from ..functions.materialize import materialized
from .boxes import occlusion
from .fields import field_kind
from .intervals import holds, innermost, marked_by, within

#: Vocabulary of roles, tags and attributes.
INTERACTIVE_ROLES = (
    "button", "link", "checkbox", "radio", "textbox", "combobox", "listbox", "menuitem",
    "menuitemcheckbox", "menuitemradio", "option", "tab", "treeitem", "slider", "spinbutton", "searchbox",
    "switch", "gridcell", "columnheader", "rowheader", "tooltip", "tree", "tabpanel", "progressbar",
    "scrollbar",
)
INTERACTIVE_TAGS = (
    "a", "button", "input", "select", "textarea", "option", "summary", "menu",
    "menuitem", "embed", "canvas", "object",
)
STRONG_TAGS = (
    "a", "button", "input", "select", "textarea", "summary", "option",
)
STRUCTURAL_TAGS = (
    "nav", "header", "footer", "main", "section", "article", "form", "ul",
    "ol", "li", "aside", "dialog", "fieldset", "details", "table", "thead",
    "tbody", "tfoot", "tr",
)
WIDGET_ATTRIBUTES = (
    "aria-checked", "aria-expanded", "aria-pressed", "aria-selected", "aria-required", "aria-haspopup", "aria-keyshortcuts", "aria-autocomplete",
)
SEARCH_WORDS = "search|magnify|glass|lookup|find|query"
INPUT_ROLES = {"checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinbutton", "search": "searchbox", "submit": "button", "button": "button", "reset": "button", "image": "button"}
TAG_ROLES = {"button": "button", "textarea": "textbox", "option": "option", "summary": "button", "progress": "progressbar", "dialog": "dialog", "form": "form", "nav": "navigation", "main": "main"}
EDITABLE = ("true", "", "plaintext-only")
NO_VALUE = ("checkbox", "radio", "submit", "button")
NAME_CHARS, MIN_SIZE, MARGIN = 80, 10, 200
CONTAINED, LEAST_SHOWN = 0.9, 0.01


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_attr(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def filled(column: Column) -> Column:
    """Null instead of blank text."""
    return F.nullif(squash(column), F.lit(""))


def looked_up(column: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def input_type() -> Column:
    return F.lower(F.coalesce(attr("type"), F.lit("text")))


def implicit_role() -> Column:
    tag = F.col("tag")
    many = has_attr("multiple") | (F.coalesce(attr("size").try_cast("int"), F.lit(0)) > 1)
    return (
        F.when(tag == "input", F.coalesce(looked_up(input_type(), INPUT_ROLES), F.lit("textbox")))
        .when(tag == "select", F.when(many, "listbox").otherwise("combobox"))
        .when(tag.isin("a", "area"), F.when(has_attr("href"), "link"))
        .when(tag == "img", F.when(attr("alt") == "", "presentation").otherwise("img"))
        .otherwise(looked_up(tag, TAG_ROLES))
    )


def node_role(nodes: DataFrame) -> DataFrame:
    """Adds ``role``: the declared one, else the tag's own, else empty."""
    declared = F.get(F.split(F.lower(filled(attr("role"))), " "), 0)
    return nodes.withColumn("role", F.coalesce(declared, implicit_role(), F.lit("")))


def _editable() -> Column:
    return is_one_of(attr("contenteditable"), EDITABLE)


def focusable() -> Column:
    tag = F.col("tag")
    enabled = tag.isin("input", "select", "textarea", "button") & ~has_attr("disabled")
    return ~is_one_of(F.coalesce(attr("tabindex"), F.lit("")), ("-1", "")) | _editable() | (tag.isin("a", "area") & has_attr("href")) | enabled | tag.isin("summary", "iframe")


def widget_state() -> Column:
    return F.arrays_overlap(F.map_keys("attrs"), lit_array(WIDGET_ATTRIBUTES))


def search_hint() -> Column:
    told = lambda k, v: (k.isin("class", "id") | k.startswith("data-")) & F.lower(v).rlike(SEARCH_WORDS)
    return F.size(F.map_filter("attrs", told)) > 0


def declares_control() -> Column:
    return has_attr("href") | has_attr("onclick") | _editable()


def pointer() -> Column:
    return F.coalesce(attr("style"), F.lit("")).rlike(r"cursor\s*:\s*pointer")


def node_focusable(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("focusable", focusable())


def node_widget_state(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("widget_state", widget_state())


def node_search_hint(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("search_hint", search_hint())


def _role_or_tag(tags: tuple[str, ...]) -> Column:
    return F.col("tag").isin(*tags) | is_one_of(F.col("role"), INTERACTIVE_ROLES)


def node_interactive(nodes: DataFrame) -> DataFrame:
    any_signal = _role_or_tag(INTERACTIVE_TAGS) | pointer() | focusable() | widget_state() | declares_control() | search_hint()
    return nodes.withColumn("interactive", any_signal)


def node_strong_signal(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("strong", _role_or_tag(INTERACTIVE_TAGS) | declares_control())


def node_strong_element(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("strong_element", _role_or_tag(STRONG_TAGS) | declares_control())


def node_link_or_button(nodes: DataFrame) -> DataFrame:
    told = F.col("tag").isin("a", "button") | has_attr("href") | has_attr("onclick") | is_one_of(F.col("role"), ("link", "button"))
    return nodes.withColumn("link_or_button", told)


def _visible() -> Column:
    """A node that does not hide itself, under opacities whose product (``shown``, which parsing carries down) is not nothing."""
    style = F.lower(F.coalesce(attr("style"), F.lit("")))
    hidden = F.coalesce(attr("aria-hidden") == "true", F.lit(False)) | style.rlike(r"display\s*:\s*none") | style.rlike(r"visibility\s*:\s*hidden")
    return ~hidden & (F.col("shown") > LEAST_SHOWN)


def node_visible(nodes: DataFrame) -> DataFrame:
    """Nodes that neither hide themselves nor stand under an opacity that comes to nothing."""
    return nodes.where(_visible())


def near_viewport(width: float, height: float, margin: float = MARGIN, min_size: float = MIN_SIZE) -> Column:
    pinned = is_one_of(F.col("position"), ("fixed", "sticky"))
    near = (F.col("y") + F.col("height") > -margin) & (F.col("x") + F.col("width") > -margin) & (F.col("y") < height + margin) & (F.col("x") < width + margin)
    return (F.col("width") >= min_size) & (F.col("height") >= min_size) & (pinned | near)


def node_near_viewport(nodes: DataFrame, bounds: DataFrame, width: float, height: float, margin: float = MARGIN, min_size: float = MIN_SIZE) -> DataFrame:
    """Nodes with ``bounds(page_id, node_id, x, y, width, height, position)`` large enough and near the viewport."""
    return nodes.join(bounds.where(near_viewport(width, height, margin, min_size)), ["page_id", "node_id"])


def node_scrollable(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds ``scrollable``: the node or an ancestor below the body has more content than it shows and may scroll."""
    over = lambda way, content, shown: is_one_of(F.col(way), ("auto", "scroll")) & (F.col(content) > F.col(shown) + 1)
    boxes = metrics.where(over("overflow_y", "scroll_height", "client_height") | over("overflow_x", "scroll_width", "client_width")).select("page_id", F.col("node_id").alias("of"))
    boxes = boxes.join(nodes.where(F.col("tag").isin("html", "body")).select("page_id", F.col("node_id").alias("of")), ["page_id", "of"], "left_anti")
    marked = marked_by(nodes, boxes.withColumnRenamed("of", "node_id"), "box")
    hit = marked.withColumn("scrollable", F.col("box") | within(F.col("box"))).where("scrollable").select("page_id", "node_id", "scrollable")
    return nodes.join(hit.hint("merge"), ["page_id", "node_id"], "left").withColumn("scrollable", F.coalesce("scrollable", F.lit(False)))


def label_for(nodes: DataFrame) -> DataFrame:
    """``page_id, node_id, label``: the label that names a node's id, else the nearest one with a text that holds the node."""
    labels = nodes.where((F.col("tag") == "label") & filled(F.col("inline_text")).isNotNull()).select("page_id", "node_id", "pos", attr("for").alias("_id"), squash(F.col("inline_text")).alias("label"))
    by_id = labels.where(F.col("_id").isNotNull()).groupBy("page_id", "_id").agg(F.min_by("label", "pos").alias("label"), F.lit(0).alias("_way"))
    named = nodes.where(has_attr("id")).select("page_id", "node_id", attr("id").alias("_id")).join(by_id.hint("merge"), ["page_id", "_id"]).select("page_id", "node_id", "label", "_way")
    inside = nodes.where(F.col("label_id").isNotNull()).select("page_id", "node_id", F.col("label_id").alias("_of"))
    wrapped = inside.join(labels.select("page_id", F.col("node_id").alias("_of"), "label").hint("merge"), ["page_id", "_of"]).select("page_id", "node_id", "label", F.lit(1).alias("_way"))
    return named.union(wrapped).groupBy("page_id", "node_id").agg(F.min_by("label", "_way").alias("label"))


def labelled_by(nodes: DataFrame) -> DataFrame:
    """``page_id, node_id, label``: the texts of the nodes that aria-labelledby lists, in its order."""
    listed = nodes.where(has_attr("aria-labelledby")).select("page_id", "node_id", F.posexplode(F.split(squash(attr("aria-labelledby")), " ")).alias("nth", "_id"))
    text = squash(F.coalesce(F.nullif("inline_text", F.lit("")), "desc_text"))
    targets = nodes.where(has_attr("id")).groupBy("page_id", attr("id").alias("_id")).agg(F.min_by(text, "pos").alias("t"))
    parts = listed.join(targets.where(F.col("t") != "").hint("merge"), ["page_id", "_id"]).groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("nth", "t"))).alias("parts"))
    return parts.select("page_id", "node_id", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("label"))


def container_labels(nodes: DataFrame) -> DataFrame:
    """Adds ``label``, what a container is called: the texts that it refers to, else its own label; null if neither."""
    rows = nodes.join(labelled_by(nodes).withColumnRenamed("label", "_referred").hint("merge"), ["page_id", "node_id"], "left")
    return rows.withColumn("label", _container_label()).drop("_referred")


def _container_label() -> Column:
    return F.coalesce(filled(F.col("_referred")), filled(attr("aria-label")))


def _name() -> Column:
    """The accessible name by precedence of its sources, over node columns and ``_referred`` and ``_label``."""
    tag, kind = F.col("tag"), input_type()
    return F.coalesce(
        filled(F.col("_referred")),
        filled(attr("aria-label")),
        F.when((tag == "input") & kind.isin("submit", "button", "reset"), filled(attr("value"))),
        F.when((tag == "img") | ((tag == "input") & (kind == "image")), filled(attr("alt"))),
        filled(F.col("_label")),
        filled(attr("placeholder")),
        filled(attr("title")),
        filled(F.col("inline_text")),
        filled(F.col("desc_text")),
        filled(attr("name")),
        F.lit(""),
    )


def with_labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows``, some of ``nodes``, with ``_label`` and ``_referred``, dealt by page: what is asked of other nodes comes to them in one exchange.

    A join by page and node would deal both sides by both, and what follows by page again.
    """
    own = rows.select("page_id", "node_id", F.struct(*[c for c in rows.columns if c not in ("page_id", "node_id")]).alias("_row"))
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    told = label_for(nodes).withColumnRenamed("label", "_label").withColumns(none("_referred"))
    referred = labelled_by(nodes).withColumnRenamed("label", "_referred").withColumns(none("_label"))
    empty = F.lit(None).cast(own.schema["_row"].dataType)
    every = own.withColumns(none("_label", "_referred"))
    for part in (told, referred):
        every = every.unionByName(part.withColumn("_row", empty))
    met = every.repartition("page_id").groupBy("page_id", "node_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_row", "_label", "_referred")])
    return met.where(F.col("_row").isNotNull()).select("page_id", "node_id", "_row.*", "_label", "_referred")


def node_name(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``name``, the accessible name; whole, so that redaction comes before any cut."""
    name = _name()
    return with_labels(nodes, nodes).withColumn("name", truncated(name, limit) if limit else name).drop("_referred", "_label")


def node_value(nodes: DataFrame) -> DataFrame:
    """Adds ``value``: what an input, text area or list holds now; empty for boxes and buttons."""
    options = nodes.where(F.col("tag") == "option").where(F.col("select_id").isNotNull()).select("page_id", F.col("select_id").alias("node_id"), "pos", has_attr("selected").alias("_on"), squash(F.array_join("own_texts", "")).alias("_text"))
    chosen = options.groupBy("page_id", "node_id").agg(F.max_by("_text", F.struct("_on", (-F.col("pos")).alias("first"))).alias("_chosen"))
    rows = nodes.join(chosen.hint("merge"), ["page_id", "node_id"], "left")
    typed = F.when(is_one_of(input_type(), NO_VALUE), "").otherwise(squash(F.coalesce(attr("value"), F.lit(""))))
    value = F.when(F.col("tag") == "input", typed).when(F.col("tag") == "textarea", squash(F.array_join("own_texts", ""))).when(F.col("tag") == "select", F.coalesce("_chosen", F.lit(""))).otherwise("")
    return rows.withColumn("value", value).drop("_chosen")


def _sensitive() -> Column:
    """The kind that a node's declaration gives, over node columns and ``_label``."""
    words = F.concat_ws(" ", attr("aria-label"), attr("name"), attr("placeholder"), attr("id"), F.when(F.col("tag").isin("input", "textarea"), F.col("_label")))
    return field_kind(F.col("tag"), attr("type"), attr("autocomplete"), attr("role"), _editable(), words)


def node_sensitive(nodes: DataFrame) -> DataFrame:
    """Adds ``sensitive``: the kind that the node's declaration gives."""
    label = label_for(nodes).withColumnRenamed("label", "_label")
    return nodes.join(label.hint("merge"), ["page_id", "node_id"], "left").withColumn("sensitive", _sensitive()).drop("_label")


def node_states(nodes: DataFrame) -> DataFrame:
    """Adds ``states`` from attributes, and ``value=`` if the columns ``value`` (already redacted) and ``sensitive`` are there."""
    on = lambda name, value: F.coalesce(attr(name) == value, F.lit(False))
    box = (F.col("tag") == "input") & is_one_of(input_type(), ("checkbox", "radio"))
    popup = attr("aria-haspopup")
    states = [
        F.when(F.when(box, has_attr("checked")).otherwise(on("aria-checked", "true")), "checked"),
        F.when(~box & on("aria-checked", "mixed"), "mixed"),
        F.when(on("aria-expanded", "true"), "expanded").when(on("aria-expanded", "false"), "collapsed"),
        F.when(on("aria-pressed", "true"), "pressed").when(on("aria-pressed", "mixed"), "pressed:mixed"),
        F.when(on("aria-selected", "true") | ((F.col("tag") == "option") & has_attr("selected")), "selected"),
        F.when(has_attr("disabled") | on("aria-disabled", "true"), "disabled"),
        F.when(has_attr("required") | on("aria-required", "true"), "required"),
        F.when(popup.isNotNull() & ~popup.isin("", "false"), F.concat(F.lit("haspopup="), popup)),
    ]
    if "value" in nodes.columns:
        shown = F.when(F.col("sensitive").isNotNull(), F.col("value")).otherwise(F.concat(F.lit('"'), F.col("value"), F.lit('"')))
        states.append(F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.concat(F.lit("value="), shown)))
    return nodes.withColumn("states", F.array_compact(F.array(*states)))


def internal_url(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("internal", F.col(url).rlike("(?i)^(chrome|edge|about|chrome-extension|devtools|view-source):"))


def _dominated() -> Column:
    """Whether a node above has the same name in ``_named``, and is strong or the node weak."""
    weaker = within(F.lit(True), "_named") & ~F.col("strong")
    return F.col("_named").isNotNull() & (within(F.col("strong"), "_named") | weaker)


def name_dominance(candidates: DataFrame) -> DataFrame:
    """Drops a node that a candidate above it names alike, if that one is strong or the node is weak.

    The rule is transitive, so testing against all named candidates equals testing against kept
    ones: candidates of one page and name in their order, and how far the ones before reach.
    """
    rows = candidates.withColumn("_named", F.nullif("name", F.lit("")))
    return rows.withColumn("_gone", _dominated()).where(~F.col("_gone")).drop("_gone", "_named")


def nearest_kept_ancestor(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """``page_id, node_id, ancestor``: the nearest of ``kept`` above each node."""
    met = innermost(marked_by(nodes, kept, "kept"), F.col("kept"), "_level", ancestor=F.col("node_id"))
    return met.where(F.col("ancestor").isNotNull()).select("page_id", "node_id", "ancestor")


def collapse_wrappers(candidates: DataFrame) -> DataFrame:
    """Of stacked controls the redundant one goes, in document order within a page.

    A weak node under a link or button goes; of two that nearly coincide the weak one goes, the
    outer one if both are weak, none if both are strong. Each step looks at what is still there.
    Columns: ``page_id, node_id, last, strong_element, link_or_button, x, y, width, height``. One pass
    over the nodes of a task's pages, with those on a stack whose subtrees are open.
    """
    names = ("page_id", "node_id", "last", "strong_element", "link_or_button", *(boxes := ("x", "y", "width", "height")))
    number = lambda column: pc.fill_null(column.cast(pa.float64()), float("nan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches that hold a page that has not ended, and of each of their rows whether it stays.
        held: list[pa.RecordBatch] = []
        left: list[bool] = []
        open_: list[tuple[int, tuple]] = []
        page, began = None, 0

        def ended(upto: int) -> Iterator[pa.RecordBatch]:
            """The first ``upto`` rows held, without those that have gone."""
            nonlocal held, left
            if not upto:
                return
            rest = []
            at = 0
            for batch in held:
                n = min(max(upto - at, 0), batch.num_rows)
                if n:
                    yield batch.slice(0, n).filter(pa.array(left[at : at + n]))
                if n < batch.num_rows:
                    rest.append(batch.slice(n))
                at += batch.num_rows
            held, left = rest, left[upto:]

        for batch in batches:
            if not batch.num_rows:
                continue
            start = len(left)
            held.append(batch)
            left += [True] * batch.num_rows
            for place, row in enumerate(zip(*[(number(batch.column(c)) if c in boxes else batch.column(c)).to_pylist() for c in names], strict=True), start):
                if row[0] != page or not place:
                    page, began = row[0], place
                    open_.clear()
                _, node, _, strong, _, x, y, width, height = row
                # Off the stack goes what has ended, and what has gone: it is nobody's outer control any more.
                while open_ and (open_[-1][1][2] < node or not left[open_[-1][0]]):
                    open_.pop()
                outer = open_[-1] if open_ else None
                open_.append((place, row))
                if outer is None:
                    continue
                _, _, _, outer_strong, outer_link, ox, oy, outer_width, outer_height = outer[1]
                if not strong and outer_link:
                    left[place] = False
                    continue
                across = max(0.0, min(ox + outer_width, x + width) - max(ox, x))
                down = max(0.0, min(oy + outer_height, y + height) - max(oy, y))
                area = width * height
                if not area or across * down / area < CONTAINED or (outer_strong and strong):
                    continue
                left[place if outer_strong else outer[0]] = False
            yield from ended(began)
            open_[:] = [(place - began, row) for place, row in open_]
            began = 0
        yield from ended(len(left))

    return candidates.repartition("page_id").sortWithinPartitions("page_id", "node_id").mapInArrow(run, candidates.schema)


def structural_containers(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes of structural tags that stand above a kept node and are not kept themselves."""
    marked = marked_by(nodes, kept, "kept")
    above = marked.withColumn("_above", holds(F.col("kept"))).where(F.col("_above") & ~F.col("kept"))
    return nodes.where(F.col("tag").isin(*STRUCTURAL_TAGS)).join(above.select("page_id", "node_id").hint("merge"), ["page_id", "node_id"], "left_semi")


def attach_parents(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept nodes and their containers with ``parent``, the nearest of both above (null at the root), and ``level``."""
    structural = nodes.where(F.col("tag").isin(*STRUCTURAL_TAGS)).select("page_id", "node_id", "last")
    marked = marked_by(structural.unionByName(nodes.join(kept.select("page_id", "node_id").hint("merge"), ["page_id", "node_id"], "left_semi").select("page_id", "node_id", "last")), kept, "kept")
    shown = marked.withColumn("_shown", F.col("kept") | holds(F.col("kept"))).where("_shown").drop("_shown", "kept")
    met = innermost(shown, F.lit(True), "level", parent=F.col("node_id")).select("page_id", "node_id", "parent", "level")
    return nodes.join(met.hint("merge"), ["page_id", "node_id"])


def document_order(df: DataFrame) -> DataFrame:
    return df.orderBy("page_id", "pos")


def role_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("page_id", "role").agg(F.count("*").alias("elements"))


def classified_counts(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("sensitive").isNotNull()).groupBy("page_id", F.col("sensitive").alias("kind")).agg(F.count("*").alias("fields"))


#: Columns of a node that later steps read; texts stay behind once names are known.
_NODE = ("page_id", "node_id", "parent_id", "last", "depth", "pos", "tag", "attrs", "shadow")


def _signals(nodes: DataFrame) -> DataFrame:
    return node_link_or_button(node_strong_element(node_strong_signal(node_interactive(node_role(nodes)))))


_SIGNALS = ("role", "interactive", "strong", "strong_element", "link_or_button")


def candidates(nodes: DataFrame) -> DataFrame:
    """Visible interactive nodes with role, strength and name, dealt by page; nameless weak ones are layout."""
    rows = with_labels(_signals(node_visible(nodes)).where("interactive"), nodes).withColumn("name", _name())
    return rows.where(F.col("strong") | (F.col("name") != "")).select(*_NODE, *_SIGNALS, "name")


def placed_controls(nodes: DataFrame) -> DataFrame:
    """The controls that stay and their containers, each with ``element`` (whether it is a control), ``name``, ``label`` (of a container), ``sensitive``, ``parent`` and ``level``.

    All of name dominance, weak nodes inside, containers and parents for every page, after one
    exchange by page of the rows that can matter, without their texts.
    """
    seen = F.col("interactive") & F.col("_seen")
    rows = _signals(nodes).withColumn("_seen", _visible()).withColumn("_structural", F.col("tag").isin(*STRUCTURAL_TAGS)).where(seen | F.col("_structural"))
    rows = with_labels(rows, nodes).withColumns({"name": F.when(seen, _name()), "label": _container_label(), "sensitive": _sensitive()})
    rows = rows.select(*_NODE, *_SIGNALS, "name", "label", "sensitive", "_structural", (seen & (F.col("strong") | (F.col("name") != ""))).alias("element"))
    rows = rows.withColumn("_named", F.when(F.col("element"), F.nullif("name", F.lit(""))))
    rows = rows.withColumn("element", F.col("element") & ~_dominated()).drop("_named").where(F.col("element") | F.col("_structural"))
    rows = _without_weak(rows)
    rows = rows.withColumn("_shown", F.col("element") | (F.col("_structural") & holds(F.col("element")))).where("_shown").drop("_shown", "_structural")
    return innermost(rows, F.lit(True), "level", parent=F.col("node_id"))


def _without_weak(rows: DataFrame) -> DataFrame:
    """Elements that are weak and right under an element that is a link or a button are none any more."""
    met = innermost(rows, F.col("element"), "_level", _link=F.col("link_or_button"))
    weak = F.col("element") & ~F.col("strong_element") & F.coalesce("_link", F.lit(False))
    return met.withColumn("element", F.col("element") & ~weak).drop("_level", "_link")


#: Steps of a scan, in their order.
FUNNEL = ("visited", "interactive", "after_name", "after_occlusion", "final")


def scan_funnel(nodes: DataFrame, bounds: DataFrame | None = None, width: float = 0, height: float = 0, observation: Observation | None = None) -> DataFrame:
    """``page_id, visited, interactive, after_name, after_occlusion, final``: how many nodes each step keeps.

    With ``bounds(page_id, node_id, x, y, w, h, paint_order)`` of a viewport of that size controls
    that something covers go, and stacked ones are collapsed; a control without bounds shows
    nowhere. Without bounds nothing is covered, and weak controls inside others go. Every step's
    rows are counted as they pass into the one grouping by page; ``observation`` gets the totals of
    all pages from the same pass.
    """
    kept = materialized(name_dominance(candidates(nodes)))
    if bounds is None:
        shown, final = kept, without_weak_inside(kept)
    else:
        boxed = materialized(kept.join(bounds.select("page_id", "node_id", "x", "y", "w", "h").hint("merge"), ["page_id", "node_id"]))
        shown = materialized(occlusion(boxed, bounds, width, height))
        final = collapse_wrappers(shown.select("page_id", "node_id", "last", "strong_element", "link_or_button", "x", "y", F.col("w").alias("width"), F.col("h").alias("height")))
    one = lambda name: {c: F.lit(int(c == name)) for c in FUNNEL}
    seen = (F.col("interactive") & _visible()).cast("int")
    every = node_interactive(node_role(nodes)).select("page_id", *[c.alias(n) for n, c in (one("visited") | {"interactive": seen}).items()])
    for rows, name in ((kept, "after_name"), (shown, "after_occlusion"), (final, "final")):
        every = every.unionByName(rows.select("page_id", *[c.alias(n) for n, c in one(name).items()]))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FUNNEL]
    every = every if observation is None else every.observe(observation, *sums)
    return every.groupBy("page_id").agg(*sums)


def without_weak_inside(kept: DataFrame) -> DataFrame:
    """Without boxes: weak nodes right under a kept link or button go."""
    rows = node_link_or_button(node_strong_element(kept)).withColumn("element", F.lit(True))
    return _without_weak(rows).where("element").drop("element")


def page_scan_report(pages: DataFrame, elements: DataFrame, regions: DataFrame, frames: DataFrame) -> DataFrame:
    """``page_id, url, elements, regions, frames, fields`` of every page."""
    out = pages.select("page_id", "url")
    fields = elements.where(F.col("sensitive").isNotNull())
    for df, name in ((elements, "elements"), (regions, "regions"), (frames, "frames"), (fields, "fields")):
        out = out.join(df.groupBy("page_id").agg(F.count("*").alias(name)).hint("merge"), "page_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def latest_scan(elements: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows of the newest scan of each page."""
    newest = elements.groupBy(*by).agg(F.max("scan_id").alias("scan_id"))
    return elements.join(newest.hint("shuffle_hash"), [*by, "scan_id"], "left_semi")


def stale_action_ids(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Actions whose element the latest scan of their page lacks."""
    current = latest_scan(elements).select("page_id", "element_id").distinct()
    return actions.join(current.hint("merge"), ["page_id", "element_id"], "left_anti")


#: Fixed value: frames smaller than this show nothing.
MIN_FRAME = 50


#: Fixed value: what handles of embedded pages look like before their frame's tag is put in.
FRAME_HANDLE = r"\[redacted:([a-z-]+)#([a-z0-9-]+)\]"


def frame_paths(frames: DataFrame, max_depth: int | None = None, max_frames: int | None = None) -> DataFrame:
    """Every way from an embedded page up to a page above it: ``page_id, top_id, tag, depth, dx, dy, left, top, right, bottom``.

    ``frames(page_id, pos, child_page_id, x, y, width, height, border_left, border_top)``. What
    lies in the page at x, y lies in the upper one at x + dx, y + dy, as far as the rectangle shows
    it. Ways double in length each round (those of length 2^k after k joins), so that the joins
    grow with the logarithm of the depth. A page that stands above itself is not embedded again,
    as in browsers; a way that shows nothing is not gone on with.
    """
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    usable = frames.where((F.col("width") >= MIN_FRAME) & (F.col("height") >= MIN_FRAME)).withColumn("nth", nth)
    usable = usable if max_frames is None else usable.where(F.col("nth") <= max_frames)
    one = usable.select(
        F.col("child_page_id").alias("page_id"), F.col("page_id").alias("top_id"), F.concat(F.lit("f"), F.col("nth").cast("string"), F.lit("-")).alias("tag"), F.lit(1).alias("depth"), (F.col("x") + F.col("border_left")).alias("dx"), (F.col("y") + F.col("border_top")).alias("dy"),
        F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("height")).alias("bottom"), F.array("child_page_id", "page_id").alias("_pages"),
    )

    def chained(inner: DataFrame, outer: DataFrame) -> DataFrame:
        up = outer.select(F.col("page_id").alias("top_id"), *[F.col(c).alias(f"_{c}") for c in outer.columns if c != "page_id"])
        met = inner.join(up.hint("merge"), "top_id").where(F.size(F.array_intersect("_pages", "__pages")) == 1)
        met = met.select(
            "page_id", F.col("_top_id").alias("top_id"), F.concat("_tag", "tag").alias("tag"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("dx") + F.col("_dx")).alias("dx"), (F.col("dy") + F.col("_dy")).alias("dy"),
            F.greatest(F.col("left") + F.col("_dx"), "_left").alias("left"), F.greatest(F.col("top") + F.col("_dy"), "_top").alias("top"), F.least(F.col("right") + F.col("_dx"), "_right").alias("right"), F.least(F.col("bottom") + F.col("_dy"), "_bottom").alias("bottom"),
            F.array_union("_pages", "__pages").alias("_pages"),
        )
        return met.where((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))

    longest, found, length = materialized(one.where("page_id <> top_id")), None, 1
    while not longest.isEmpty() and (max_depth is None or length <= max_depth):
        # Found are all ways shorter than ``length``; longest are those of just that length.
        found = longest if found is None else found.unionByName(longest).unionByName(chained(found, longest))
        found, longest, length = materialized(found), materialized(chained(longest, longest)), 2 * length
    found = longest if found is None else found
    return (found if max_depth is None else found.where(F.col("depth") <= max_depth)).drop("_pages")


def embedded(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows(page_id, x, y, width, height, ...)`` of embedded pages where they show in the pages above, clipped, with ``tag`` and ``depth``."""
    ways = paths.select("page_id", F.col("top_id").alias("_top_id"), F.col("tag").alias("_tag"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in ("dx", "dy", "left", "top", "right", "bottom")])
    met = rows.join(ways.hint("merge"), "page_id")
    left, top = F.greatest(F.col("x") + F.col("_dx"), "_left"), F.greatest(F.col("y") + F.col("_dy"), "_top")
    right, bottom = F.least(F.col("x") + F.col("width") + F.col("_dx"), "_right"), F.least(F.col("y") + F.col("height") + F.col("_dy"), "_bottom")
    shown = met.withColumns({"_l": left, "_t": top, "_r": right, "_b": bottom}).where((F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")))
    place = {"page_id": F.col("_top_id"), "x": F.col("_l"), "y": F.col("_t"), "width": F.col("_r") - F.col("_l"), "height": F.col("_b") - F.col("_t")}
    return shown.select(*[place[c].alias(c) if c in place else c for c in rows.columns], F.col("_tag").alias("tag"), F.col("_depth").alias("depth"))


def _first_of_page(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    if most is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(order))).where(F.col("_n") <= most).drop("_n")


def inline_frames(elements: DataFrame, frames: DataFrame, max_depth: int | None = None, max_frames: int | None = None, max_elements: int | None = None) -> DataFrame:
    """Elements of embedded pages in the coordinates of every page above them, clipped to the frames between.

    ``elements(page_id, element_id, name, x, y, width, height)`` gains ``tag`` (``f1-``, ``f1-2-``
    by level), ``depth`` and ``top_id``; for ``frames`` see ``frame_paths``. Handles in the names of
    embedded elements get the tag, so that two pages' handles never meet. The three numbers limit
    levels, frames of a page and elements of an embedded page only where they are given.
    """
    own = elements.withColumns({"tag": F.lit(""), "depth": F.lit(0)})
    inner = embedded(_first_of_page(elements, "element_id", max_elements), frame_paths(frames, max_depth, max_frames))
    tagged = F.regexp_replace("name", F.lit(FRAME_HANDLE), F.concat(F.lit("[redacted:$1#"), F.col("tag"), F.lit("$2]")))
    return own.unionByName(inner.withColumn("name", tagged)).withColumn("top_id", F.col("page_id"))


def inline_regions(regions: DataFrame, frames: DataFrame, max_depth: int | None = None, max_frames: int | None = None, max_regions: int | None = None, order: str = "region_id") -> DataFrame:
    """``regions(page_id, x, y, width, height, ...)`` of pages and of what they embed, in the coordinates of the upper page, with ``tag`` and ``depth``."""
    own = regions.withColumns({"tag": F.lit(""), "depth": F.lit(0)})
    return own.unionByName(embedded(_first_of_page(regions, order, max_regions), frame_paths(frames, max_depth, max_frames)))
