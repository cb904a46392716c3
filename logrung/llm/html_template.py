"""Main text of web pages by deducing each host's template.

Tokens are elements by their path in the tag tree. Over the pages of a host
each token has an occurrence vector, its counts page by page; tokens with
equal vectors form an equivalence class. Classes that nest in one parent class
are valid and make up the host's template. What the template repeats
unchanged, and what it fills with links, is furniture; the slots that remain
are the pages' own text.

Vectors are never built: a token's vector is summed into a 64-bit fingerprint,
so a host with a third of all pages is aggregated like any other, in each task
first and then by host and token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logrung.llm.html_blocks import Run, joined, walk
from logrung.llm.url_filter import host_of
from logrung.session import landed

#: A token of the template occurs on this share of a host's pages at least.
SUPPORT = 0.5
#: Below so many pages of unlike text nothing can be told to be constant.
LEAST_PAGES = 3
#: Share of a slot's characters inside links from which it is a menu.
LINK_SHARE = 0.5
#: Share of a host's free text that its article or main element must hold to be taken for one.
MAIN_SHARE = 0.5
#: Without such an element, a container that holds this share of a host's free text is the main one.
DENSE_SHARE = 0.8
#: Blocks of nothing but links are a slot of their own beside the sentences of the same path.
_LINKS = "/=links"

_NUMBERS = (
    "pages", "occurrences", "vector", "chars", "link_chars", "main_chars", "own_chars", "lowest", "highest"
)
_TOKENS = (
    "host string, token string, pages long, occurrences long, vector long, chars long, link_chars long, "
    "main_chars long, own_chars long, lowest long, highest long, contents array<long>"
)
_TOKEN_SCHEMA = pa.schema(
    [
        ("host", pa.string()),
        ("token", pa.string()),
        *[(c, pa.int64()) for c in _NUMBERS],
        ("contents", pa.list_(pa.int64())),
    ]
)
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slotted(html: str) -> Iterator[tuple[str, Run | None]]:
    """(path, None) of every element as it opens, (slot, run) of every text run.

    A slot is the block around a run: an inline element, such as a link, is part of a sentence and no slot.
    """
    items = list(walk(html))
    plain = {x.block for x in items if isinstance(x, Run) and not x.link and any(map(str.isalnum, x.text))}
    linked = {x.block for x in items if isinstance(x, Run) and x.link and not x.text.isspace()} - plain
    opened = set()
    for x in items:
        if isinstance(x, str):
            yield x, None
            continue
        slot = x.slot
        if x.block in linked:
            slot += _LINKS
            if x.block not in opened:
                opened.add(x.block)
                yield slot, None
        yield slot, x


def _page_tokens(html: str) -> tuple[dict[str, list[int]], int]:
    """token -> [occurrences, chars, those in links, in main, not boilerplate, hash of its text], and a hash of all text."""
    found: dict[str, list] = {}
    texts: dict[str, list[str]] = {}
    whole: list[str] = []
    for slot, run in _slotted(html):
        if run is None:
            found.setdefault(slot, [0, 0, 0, 0, 0, 0])[0] += 1
        elif not run.text.isspace():
            own = found.setdefault(slot, [0, 0, 0, 0, 0, 0])
            size = len(run.text.strip())
            own[1] += size
            own[2] += size if run.link else 0
            own[3] += size if run.main and not run.boilerplate else 0
            own[4] += 0 if run.boilerplate else size
            text = " ".join(run.text.split())
            texts.setdefault(slot, []).append(text)
            whole.append(text)
    for path, parts in texts.items():
        found[path][5] = _signed(xxhash.xxh64_intdigest("\n".join(parts)))
    return found, _signed(xxhash.xxh64_intdigest("\n".join(whole)))


def token_table(pages: DataFrame) -> DataFrame:
    """(host, token, ...) sums over all pages of a host; batches are summed before they are shuffled."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, row, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, content = _page_tokens(html or "")
                for token, (times, *chars, text) in page.items():
                    own = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0, 0, text, text, []])
                    own[0] += 1
                    own[1] += times
                    own[2] = (own[2] + xxhash.xxh64_intdigest(f"{row}:{times}")) & _MASK
                    for i, c in enumerate(chars, 3):
                        own[i] += c
                    own[7] = min(own[7], text)
                    own[8] = max(own[8], text)
                    if len(own[9]) < LEAST_PAGES and content not in own[9]:
                        own[9].append(content)
            rows = [(*k, v[0], v[1], _signed(v[2]), *v[3:]) for k, v in sums.items()]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _TOKEN_SCHEMA, strict=True)], schema=_TOKEN_SCHEMA
                )

    numbered = pages.select("host", F.monotonically_increasing_id().alias("row"), "html")
    # Sums of fingerprints wrap around: they are taken in two halves, which cannot overflow.
    high, low = F.shiftright("vector", 32), F.expr("vector & 4294967295")
    return (
        numbered.mapInArrow(collect, _TOKENS)
        .groupBy("host", "token")
        .agg(
            F.sum("pages").alias("pages"),
            F.sum("occurrences").alias("occurrences"),
            F.sum(high).alias("v_high"),
            F.sum(low).alias("v_low"),
            F.sum("chars").alias("chars"),
            *[F.sum(c).alias(c) for c in ("link_chars", "main_chars", "own_chars")],
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            # Of unlike page texts each batch sends LEAST_PAGES at most.
            F.size(F.array_distinct(F.flatten(F.collect_set("contents")))).alias("contents"),
        )
        .withColumn("v_high", F.col("v_high") + F.shiftright("v_low", 32))
        .withColumn("v_low", F.expr("v_low & 4294967295"))
        .withColumn("vector", F.struct(F.expr("v_high & 4294967295"), "v_low"))
        .drop("v_high", "v_low")
    )


def templates(tokens: DataFrame, host_pages: DataFrame) -> DataFrame:
    """(host, token, class, parent_class, furniture, free, main_chars, own_chars) for the tokens of valid classes.

    A class is the tokens of a host with one occurrence vector. Its parent is
    the class around it; a class whose tokens lie in several other classes
    does not nest and is left out. ``furniture`` marks a slot that reads the
    same on all its pages, LEAST_PAGES of unlike text at least, or is mostly links;
    ``free`` one that is filled differently on as many pages.
    """
    classed = landed(
        tokens.join(host_pages, "host")
        .where(F.col("pages") >= SUPPORT * F.col("host_pages"))
        .withColumn("class", F.xxhash64("pages", "occurrences", "vector"))
        .withColumn("parent", F.regexp_replace("token", r"/[^/]*$", "")),
        "template-tokens",
    )
    around = classed.select("host", F.col("token").alias("parent"), F.col("class").alias("parent_class"))
    placed = classed.join(around, ["host", "parent"], "left")
    outside = F.when(F.col("parent_class") != F.col("class"), F.col("parent_class"))
    nested = (
        placed.groupBy("host", "class")
        .agg(F.min(outside).alias("first"), F.max(outside).alias("last"))
        .where(F.col("first").eqNullSafe(F.col("last")))
        .select("host", "class", F.col("first").alias("around"))
    )
    constant = (F.col("lowest") == F.col("highest")) & (F.col("contents") >= LEAST_PAGES)
    links = F.col("link_chars") >= LINK_SHARE * F.col("chars")
    return placed.join(nested, ["host", "class"]).select(
        "host",
        "token",
        "class",
        F.col("around").alias("parent_class"),
        ((F.col("chars") > 0) & (constant | links)).alias("furniture"),
        ((F.col("chars") > 0) & (F.col("contents") >= LEAST_PAGES) & ~(constant | links)).alias("free"),
        "main_chars",
        "own_chars",
    )


def outside_of_dense(slots: list[tuple[str, int]]) -> list[str]:
    """Of (path, characters) those that lie beside the container of most text.

    From the root down, the child of the container so far that holds
    DENSE_SHARE of the text is entered as long as it is a container itself,
    that is, all its text lies in slots below it. Headings beside it stay, for
    a title often stands before its text.
    """
    inside, beside, depth = slots, [], 1
    while True:
        mass: dict[str, int] = {}
        flat: set[str] = set()
        for path, chars in inside:
            steps = path.split("/")
            child = "/".join(steps[: depth + 1])
            mass[child] = mass.get(child, 0) + chars
            if len(steps) <= depth + 1:
                flat.add(child)
        child, most = max(mass.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if not child or child in flat or most < DENSE_SHARE * sum(mass.values()):
            return beside
        below = [s for s in inside if s[0] == child or s[0].startswith(child + "/")]
        beside += [s[0] for s in inside if s not in below and s[0].rsplit("/", 1)[-1].split(".")[0] not in _HEADINGS]
        inside, depth = below, depth + 1


_HEADINGS = frozenset("h1 h2 h3".split())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _beside(free: pa.Array) -> pa.Array:
    rows = free.to_pylist()
    return pa.array([outside_of_dense([(x["token"], x["chars"]) for x in r or ()]) for r in rows], pa.list_(pa.string()))


def slots_by_host(found: DataFrame) -> DataFrame:
    """(host, furniture, own, main_holds): what the template says of a host's slots.

    Free slots are ``own``, the text of the pages. Free slots outside the
    article or main element (advertisements also change from page to page) tie
    with those inside; ``main_holds`` breaks the tie when the slots inside hold
    most of the host's free text. Where they do not, the element is no main
    one and all free slots are own. On a host without any such element the
    template alone tells: slots beside the container of most free text are
    furniture. ``main_holds`` is null when no slot could be told.
    """
    free = F.col("free") & (F.col("own_chars") > 0)
    held = found.where("furniture or free").groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(F.col("furniture"), F.col("token")))).alias("furniture"),
        F.sort_array(
            F.collect_list(F.when(free, F.struct("token", (F.col("main_chars") > 0).alias("main"), F.col("own_chars").alias("chars"))))
        ).alias("free"),
        F.sum(F.when(free, F.col("main_chars"))).alias("inside"),
        F.sum(F.when(free, F.col("own_chars"))).alias("all"),
    )
    holds = F.col("inside") >= MAIN_SHARE * F.col("all")
    beside = F.when(F.col("inside") == 0, _beside("free")).otherwise(F.array().cast("array<string>"))
    own = F.filter("free", lambda x: (x["main"] | ~holds) & ~F.array_contains("beside", x["token"]))
    return held.withColumn("beside", beside).select(
        "host",
        F.array_union("furniture", "beside").alias("furniture"),
        F.transform(own, lambda x: x["token"]).alias("own"),
        holds.alias("main_holds"),
    )


def main_text(
    html: str | None, furniture: list[str] | None, own: list[str] | None = None, main_holds: bool | None = None
) -> str:
    """The page's own text: its template's own slots, and what the template leaves open.

    Open are slots that are not in the template, or on a host of too few
    pages. Those in an article or main element count as own, and others too
    where ``main_holds`` is false. Inside an article that holds, repeated text
    stays, unless a name there says boilerplate too. Without a template at all
    (``own`` is None) the name alone decides. A page with no such text gives
    all that is not furniture.
    """
    fixed, ours = set(furniture or ()), set(own or ())
    trusted = main_holds is not False
    runs = [
        (slot, x)
        for slot, x in _slotted(html or "")
        if x and not x.boilerplate and not (x.named and (own is None or slot in fixed))
    ]
    taken = [r for slot, r in runs if slot in ours or (r.main if trusted else slot not in fixed)]
    if any(not r.text.isspace() for r in taken):
        return joined(taken)
    return joined([r for slot, r in runs if slot not in fixed])


@F.arrow_udf(T.StringType())
def _extract(html: pa.Array, furniture: pa.Array, own: pa.Array, holds: pa.Array) -> pa.Array:
    rows = zip(html.to_pylist(), furniture.to_pylist(), own.to_pylist(), holds.to_pylist(), strict=True)
    return pa.array([main_text(*row) for row in rows], pa.string())


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each page of ``page_id``, ``url``, ``html``.

    Pages of one host share a template; a null url, or one without a host, is
    the host "". Null and empty html give an empty text. Repeated rows are
    pages of their own; an empty table gives no rows. Other columns are not
    read. What many pages of a host repeat inside an article stays, unless it
    also has the class, id or role of boilerplate.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn(
        "host", F.coalesce(host_of(F.col("url").cast("string")), F.lit(""))
    )
    tokens = landed(token_table(rows), "page-tokens")
    counts = landed(rows.groupBy("host").agg(F.count("*").alias("host_pages")), "host-pages")
    found = templates(tokens, counts)
    by_host = landed(slots_by_host(found), "templates")
    return rows.join(by_host, "host", "left").select(
        "page_id", "url", _extract("html", "furniture", F.coalesce("own", F.array().cast("array<string>")), "main_holds").alias("text")
    )
