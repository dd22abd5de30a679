"""Link graph and bounded site traversal over stored pages."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import html as hx
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.functions.binding import let
from pageloom.operators import chunking
from pageloom.operators import sentences as st
from pageloom.operators.rows import unnest
from pageloom.session import checkpointed
from pageloom.sources.tables import keyed_pages


def page_links(pages: DataFrame) -> DataFrame:
    """(src_url, pos, dst_url) for every anchor of every stored page; ``pages`` has page_url and html."""
    # resolved inside the array, so that filters on the links stay above the regular expressions
    src = F.col("page_url")
    absolute = urls.resolve_urls(src, hx.anchor_hrefs(F.col("html")))
    return unnest(pages, [src.alias("src_url")], F.transform(absolute, urls.canonical_url), "pos", "dst_url")


def followed_links(links: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Links the traversal may take: a keyword in the URL, the same host, a path below the page's.

    Of several links between the same two pages the first counts.
    """
    src, dst = F.col("src_url"), F.col("dst_url")
    kept = links.filter(
        urls.has_keyword(dst, keywords) & urls.same_host(src, dst) & urls.below_path(src, dst)
    )
    return kept.groupBy("src_url", urls.page_key(dst).alias("dst_url")).agg(F.min("pos").alias("pos"))


def stored_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to stored pages; one that is not stored leads nowhere and adds nothing to a site."""
    return links.join(pages.select(F.col("page_url").alias("dst_url")), "dst_url", "left_semi").select(links.columns)


def reachable_pages(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Every page each seed reaches: (seed, page_url, route).

    ``seeds`` has ``seed`` (any key) and ``url``; ``links`` is :func:`followed_links`. ``route`` is
    the smallest sequence of link positions that leads to the page. Sorting by it gives the order in
    which a depth-first walk that follows links in page order first meets the pages.

    Each round joins the pages whose route just improved with the links, and takes one minimum over
    what was known and what was found; rows whose minimum is new are the next frontier. That is one
    shuffle for the join and one for the minimum. The link table is written once and left to adaptive
    execution, which splits a page that very many seeds reach at once. Every round's table is written
    to the checkpoint folder, so no round depends on executors that may be gone and plans do not
    grow. It ends when no route improves; ``max_rounds`` is a safety stop that raises rather than
    returning part of a site.

    Visiting order holds for sites without cycles among different pages, which the path test of
    :func:`followed_links` all but ensures: a link leads to a path that begins with the page's own.
    """
    links = checkpointed(links)
    known = checkpointed(
        seeds.select("seed", urls.page_key(F.col("url")).alias("page_url"), F.array().cast("array<int>").alias("route"))
        .distinct().withColumn("fresh", F.lit(True))
    )
    rounds = 0
    while not (frontier := known.filter("fresh")).isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"routes still improve after {max_rounds} rounds")
        rounds += 1
        found = frontier.join(links, frontier["page_url"] == links["src_url"]).select(
            "seed", F.col("dst_url").alias("page_url"), F.concat("route", F.array("pos")).alias("route"), F.lit(1).alias("new")
        )
        # of equal routes the known one is the lesser, so a route is fresh only where it improved
        rows = known.select("seed", "page_url", "route", F.lit(0).alias("new")).unionByName(found)
        best = rows.groupBy("seed", "page_url").agg(F.min(F.struct("route", "new")).alias("best"))
        known = checkpointed(best.select("seed", "page_url", "best.route", (F.col("best.new") == 1).alias("fresh")))
    return known.drop("fresh")


@dataclass(frozen=True)
class SitePlaces:
    """The sentences that stay in each seed's site, in numbers; texts stand once for each stored page.

    ``places`` is (seed, at, page, route, kept), a row for each page of a site: ``at`` counts the pages from 0 in
    visiting order, ``kept`` has the positions of the sentences that occur elsewhere too and come first here.
    ``parts`` is (page, page_url, parts): the page's sentences, of which those that are ``lone`` occur nowhere else.
    """

    places: DataFrame
    parts: DataFrame

    def with_parts(self) -> DataFrame:
        """``places`` with page_url and ``said``, the page's sentences that stay, as (pos, sentence, …)."""
        own = self.parts.schema["parts"].dataType.elementType.names
        numbered = F.transform("parts", lambda p, i: F.struct(i.alias("pos"), *[p[c].alias(c) for c in own]))
        said = F.filter(numbered, lambda p: p["lone"] | F.array_contains("kept", p["pos"]))
        return self.places.join(self.parts, "page").select(*self.places.columns, "page_url", said.alias("said")).filter(F.size("said") > 0)


def _site_places(reached: DataFrame, pages: DataFrame, parts: Column) -> SitePlaces:
    """First occurrences of the sentences of each seed's pages; ``parts`` is an array of (own, sentence, …) per page.

    Sentences of one ``own`` are the same. Only those that occur more than once are numbered and compared, and what is
    shuffled for each page of each site are their numbers and places, two numbers in one, so that the least is found without a sort.
    """
    stored = pages.filter(F.col("page_url").isNotNull()).select("page_url", parts.alias("parts"))
    stored = checkpointed(stored.withColumn("page", F.monotonically_increasing_id()))  # numbers are fixed by writing them
    said = unnest(stored, ["page"], F.transform("parts", lambda p: p["own"]), "pos", "own")
    several = said.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1").select("own")
    several = checkpointed(several.withColumn("number", F.monotonically_increasing_id()))
    again = said.join(several, "own").groupBy("page").agg(F.collect_list(F.struct("pos", F.col("number").alias("own"))).alias("again"))
    fields = [c for c in stored.schema["parts"].dataType.elementType.names if c != "own"]
    places = F.transform(F.coalesce("again", F.array()), lambda a: a["pos"])
    marked = let(places, lambda found: F.transform(
        "parts", lambda p, i: F.struct(*[p[c].alias(c) for c in fields], (~F.array_contains(found, i)).alias("lone"))
    ))
    known = checkpointed(stored.join(again, "page", "left").select("page", "page_url", marked.alias("parts"), "again"))

    met = reached.join(known.select("page_url", "page"), "page_url")
    order = Window.partitionBy("seed").orderBy("route", "page_url")
    met = checkpointed(met.select("seed", (F.row_number().over(order) - 1).alias("at"), "page", "route"))
    rows = unnest(met.join(known.select("page", "again"), "page"), ["seed", "at"], "again", "_", "a")
    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("a.pos")
    first = rows.groupBy("seed", "a.own").agg(F.min(place).alias("place"))
    nowhere = [F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("page", "route")]
    parted = [F.shiftright("place", 32).cast("int").alias("at"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")]
    every = first.select("seed", *parted, *nowhere).unionByName(met.withColumn("pos", F.lit(None).cast("int")))
    kept = every.groupBy("seed", "at").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("page", "route")], F.array_sort(F.collect_list("pos")).alias("kept")
    )
    return SitePlaces(checkpointed(kept), known.drop("again"))


def site_places(reached: DataFrame, pages: DataFrame) -> SitePlaces:
    """Distinct sentences of each seed's pages, first occurrence kept; ``pages`` has one row per page_url."""
    said = F.transform(
        tx.split_sentences(hx.html_text(F.col("html"))), lambda s: F.struct(F.unhex(F.md5(s)).alias("own"), s.alias("sentence"))
    )
    return _site_places(reached, pages, said)


def cleaned_site_places(reached: DataFrame, pages: DataFrame) -> SitePlaces:
    """The sentences of :func:`site_places` that are not empty once cleaned, each with its cleaned form and tokens ``n``.

    They are still one for each sentence as it stood in the page. A page is split, cleaned and measured once,
    however many seeds reach it.
    """
    said = F.transform(
        tx.split_sentences(hx.html_text(F.col("html"))),
        lambda s: F.struct(F.unhex(F.md5(s)).alias("own"), tx.clean_text(s).alias("sentence")),
    )
    parts = F.transform(
        F.filter(said, lambda s: s["sentence"] != ""),
        lambda s: F.struct(s["own"].alias("own"), s["sentence"].alias("sentence"), tx.token_count(s["sentence"]).alias("n")),
    )
    return _site_places(reached, pages, parts)


def _sentence_rows(sites: SitePlaces, *more: str) -> DataFrame:
    rows = sites.with_parts().select("seed", "route", "page_url", F.explode("said").alias("s"))
    return rows.select("seed", "route", "s.pos", "page_url", "s.sentence", *[f"s.{c}" for c in more])


def site_sentences(reached: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct sentences of each seed's pages, first occurrence kept: (seed, route, pos, page_url, sentence)."""
    return _sentence_rows(site_places(reached, pages))


def cleaned_site_sentences(reached: DataFrame, pages: DataFrame) -> DataFrame:
    """Cleaned sentences of each seed's pages: (seed, route, pos, page_url, sentence, n), n being its tokens."""
    return _sentence_rows(cleaned_site_places(reached, pages), "n")


def site_pages(sites: SitePlaces) -> DataFrame:
    """Text of each page of each site after deduplication: (seed, at, page, route, kept, page_url, text).

    A page's sentences are joined where its row is, so nothing is shuffled by site.
    """
    text = F.array_join(F.transform("said", lambda s: s["sentence"]), " ")
    return sites.with_parts().withColumn("text", text).drop("said")


def page_texts(sites: SitePlaces) -> DataFrame:
    """The different texts of :func:`site_pages`, each once however many sites hold it: (page, kept, page_url, text).

    ``sites.places`` names them by page and kept.
    """
    return site_pages(SitePlaces(sites.places.select("page", "kept").distinct(), sites.parts))


def _joined_runs(at: Column, edges: Column) -> Column:
    """The sentences that must be cleaned together, as arrays of their places; those cleaned alone are left out.

    ``at`` has the places of a text's sentences and ``edges`` what :func:`pageloom.functions.text.cleaned_sentence` tells of them.
    """
    kind, closed, named, opened = 3, tx.CLOSED, tx.NAMED, tx.OPEN
    continues, begins, settles, joins = tx.CONTINUES, tx.BEGINS, tx.SETTLES, tx.JOINS

    @F.arrow_udf("array<array<int>>")
    def runs(at: pa.Array, edges: pa.Array) -> pa.Array:
        found = []
        # nothing goes on after a text that ends so
        apart = {code for code in range(2 * joins) if code & kind == closed and not code & begins}
        for places, codes in zip(at.to_pylist(), edges.to_pylist()):
            several = []
            if not apart.issuperset(codes[:-1]):
                run, last, pending = [], opened, False
                for place, code in zip(places, codes):
                    if run and not pending and (last == closed or last == named and not code & continues):
                        several += [run] * (len(run) > 1)
                        run = []
                    # of an open end and this beginning a number may be made, or unmade
                    unsettled = bool(run) and last == opened and bool(code & joins)
                    if unsettled or code & settles:
                        pending = unsettled or bool(code & begins)
                    run.append(place)
                    last = code & kind
                several += [run] * (len(run) > 1)
            found.append(several)
        return pa.array(found, type=pa.list_(pa.list_(pa.int32())))

    return runs(at, edges)


def page_sentences(sites: SitePlaces) -> DataFrame:
    """The sentences of the cleaned :func:`page_texts`, each text once: (page, kept, page_url, said).

    ``said`` is an array of (sentence, n), n being its tokens: what cleaning the text and splitting it again gives.
    A page's sentence is cleaned and split once for all its texts, unless a rule may match over its end, or it may not end there
    once cleaned; such runs of sentences are joined by :func:`page_texts`, and each different run is cleaned once.
    """
    measured = lambda cleaned: F.transform(tx.split_cleaned(cleaned), lambda s: F.struct(s.alias("sentence"), tx.cleaned_token_count(s).alias("n")))
    made = F.transform("parts", lambda p: let(tx.cleaned_sentence(p["sentence"]), lambda c: F.struct(measured(c["cleaned"]).alias("said"), c["edges"].alias("edges"))))
    lone = F.filter(F.transform("parts", lambda p, i: F.when(p["lone"], i)), lambda i: i.isNotNull())
    once = checkpointed(sites.parts.select("page", "page_url", lone.alias("lone"), made.alias("made")))

    texts = sites.places.select("page", "kept").distinct()
    at = F.sort_array(F.concat("lone", "kept"))
    placed = texts.join(once.select("page", "lone", F.col("made.edges").alias("edges")), "page")
    placed = placed.select("page", "kept", "edges", at.alias("at")).filter(F.size("at") > 0)
    runs = _joined_runs(F.col("at"), F.transform("at", lambda i: F.get("edges", i)))
    placed = checkpointed(placed.select("page", "kept", "at", runs.alias("runs")))

    several = placed.select("page", "kept", F.explode("runs").alias("run"))
    named = sites.parts.withColumn("parts", F.transform("parts", lambda p: p.withField("lone", F.lit(False))))
    joined = page_texts(SitePlaces(several.select("page", F.col("run").alias("kept")), named))
    joined = joined.select("page", F.col("kept").alias("run"), measured(tx.clean_text(F.col("text"))).alias("said"))
    again = several.join(joined, ["page", "run"]).groupBy("page", "kept").agg(F.collect_list(F.struct(F.get("run", F.lit(0)).alias("at"), "said")).alias("joined"))

    alone = lambda places: F.transform(places, lambda i: F.struct(i.alias("at"), F.get("made", i)["said"].alias("said")))
    mixed = F.array_sort(F.concat(alone(F.array_except("at", F.flatten("runs"))), F.col("joined")))
    said = F.when(F.col("joined").isNull(), alone(F.col("at"))).otherwise(mixed)
    rows = placed.join(again, ["page", "kept"], "left").join(once, "page")
    return rows.select("page", "kept", "page_url", F.flatten(F.transform(said, lambda r: r["said"])).alias("said"))


def site_text(sites: SitePlaces) -> DataFrame:
    """Cleaned text of each site: (seed, text), one row per seed.

    For the text column of the dataset. To chunk sites of any size without building their text use
    :func:`site_chunks`.

    Pages are cleaned one by one, where no match of a cleaning rule can reach from one into the next
    (:func:`pageloom.functions.text.edges`); the others are joined to what follows first. Only cleaned pages meet
    in a site's row.
    """
    pages = site_pages(sites)
    own = ["seed", "at", "page", "kept"]
    edges = pages.select(*own, tx.edges(F.col("text")).alias("e")).select(*own, "e.*")
    order = Window.partitionBy("seed").orderBy("at")
    # a page after one with an unsettled end may lose its beginning
    after = edges.withColumn("last_ends", F.lag("ends").over(order))
    open = F.coalesce(F.col("last_ends") == tx.OPEN, F.lit(False))
    after = after.withColumn("settles", F.col("settles") | open).withColumn("begins", F.col("begins") | open)
    pending = F.coalesce(F.last(F.when(F.col("settles"), F.col("begins")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    whole = ~pending & ((F.col("last_ends") == tx.CLOSED) | ((F.col("last_ends") == tx.NAMED) & ~F.col("continues")))
    cut = after.select(*own, F.when(F.col("last_ends").isNull() | whole, F.col("at")).alias("starts"))
    grouped = cut.select(*own, F.last("starts", ignorenulls=True).over(order).alias("run"), F.lead("starts").over(order).alias("next"), F.lead("at").over(order).alias("beyond"))
    runs = checkpointed(grouped.select(*own, "run", ((F.col("run") == F.col("at")) & (F.col("beyond").isNull() | F.col("next").isNotNull())).alias("alone")))
    both = site_pages(SitePlaces(runs, sites.parts)).select("seed", "run", "at", "text", "alone")
    alone = both.filter("alone").select("seed", "run", tx.clean_text(F.col("text")).alias("text"))
    joined = st.join_ordered(both.filter("NOT alone"), ["seed", "run"], ["at"], "text")
    cleaned = alone.unionByName(joined.select("seed", "run", tx.clean_text(F.col("text")).alias("text")))
    said = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("run", "text"))))
    return cleaned.groupBy("seed").agg(F.array_join(F.transform(said, lambda r: r["text"]), " ").alias("text"))


def site_chunks(sentences: SitePlaces | DataFrame, chunk_size: int, block_rows: int = chunking.BLOCK_ROWS) -> DataFrame:
    """Chunks of each site's cleaned sentences: (seed, chunk_no, n_sentences, n_tokens, sentences).

    ``sentences`` are :func:`cleaned_site_places`, or the rows of :func:`cleaned_site_sentences` or of
    :func:`site_sentences`, which are cleaned here (once for each site that holds them).
    Sentences stay rows: each is cleaned on its own, what is left is numbered without gaps in visiting
    order, and the sentence table is packed, so chunks run on across pages and chunk numbers are unique.
    A site is never one row, nor one task's group: its sentences are numbered page by page, from
    the exact counts of the pages before, and long sites are packed in blocks.
    Of places only numbers are packed; a chunk takes its sentences from the pages afterwards.
    """
    if isinstance(sentences, SitePlaces):
        return _place_chunks(sentences, chunk_size, block_rows)
    if "n" not in sentences.columns:
        cleaned = sentences.withColumn("sentence", tx.clean_text(F.col("sentence"))).filter(F.col("sentence") != "")
        sentences = cleaned.withColumn("n", tx.token_count(F.col("sentence")))
    cleaned = checkpointed(sentences)  # counted and read
    pages = cleaned.groupBy("seed", "route", "page_url").agg(F.count("*").alias("n_before"))
    before = Window.partitionBy("seed").orderBy("route", "page_url").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select("seed", "route", "page_url", F.coalesce(F.sum("n_before").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("seed", "route", "page_url").orderBy("pos"))
    numbered = cleaned.withColumn("place", place).join(starts, ["seed", "route", "page_url"]).select(
        "seed", (F.col("start") + F.col("place") - 1).alias("ord"), "sentence", "n"
    )
    packed = chunking.chunk_sentence_rows(numbered, chunk_size, "seed", "ord", "n", block_rows)
    said = F.array_sort(F.collect_list(F.struct("ord", "sentence")))
    return packed.groupBy("seed", "chunk_no").agg(
        F.count("*").cast("int").alias("n_sentences"), F.sum("n").cast("int").alias("n_tokens"),
        F.transform(said, lambda r: r["sentence"]).alias("sentences"),
    )


def _place_chunks(sites: SitePlaces, chunk_size: int, block_rows: int) -> DataFrame:
    """:func:`site_chunks` of places: numbers are packed, and texts sent once, to their chunks."""
    bare = sites.parts.select("page", "page_url", F.transform("parts", lambda p: F.struct(p["n"].alias("n"), p["lone"].alias("lone"))).alias("parts"))
    pages = SitePlaces(sites.places, bare).with_parts()
    before = Window.partitionBy("seed").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbers = F.transform("said", lambda s: F.struct(s["pos"].alias("pos"), s["n"].alias("n")))
    starts = pages.select("seed", "at", "page", numbers.alias("said"), F.coalesce(F.sum(F.size("said").cast("long")).over(before), F.lit(0)).alias("start"))
    numbered = unnest(starts, ["seed", "page", "start"], "said", "i", "s").select("seed", (F.col("start") + F.col("i")).alias("ord"), "s.n", "page", "s.pos")
    packed = chunking.chunk_sentence_rows(numbered, chunk_size, "seed", "ord", "n", block_rows)
    # the sentences of a chunk that come from one page
    pieces = packed.groupBy("seed", "chunk_no", "page").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "pos"))).alias("at"))
    texts = pieces.join(sites.parts.select("page", F.transform("parts", lambda p: p["sentence"]).alias("texts")), "page")
    own = F.transform("at", lambda a: F.get("texts", a["pos"]))
    said = F.array_sort(F.collect_list(F.struct(F.get("at", F.lit(0))["ord"].alias("ord"), own.alias("own"))))
    return texts.groupBy("seed", "chunk_no").agg(
        F.sum(F.size("at")).cast("int").alias("n_sentences"), F.sum("n").cast("int").alias("n_tokens"),
        F.flatten(F.transform(said, lambda r: r["own"])).alias("sentences"),
    )


def crawled_places(seeds: DataFrame, pages: DataFrame, keywords: list[str] | None = None) -> SitePlaces:
    """Traverse the stored pages from every seed: each site's distinct sentences, as places."""
    stored = checkpointed(keyed_pages(pages))  # read for the links and for the texts
    links = followed_links(page_links(stored), keywords)
    return site_places(reachable_pages(seeds, stored_links(links, stored)), stored)


def crawled_sentences(seeds: DataFrame, pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Traverse the stored pages from every seed and return each site's distinct sentences."""
    return _sentence_rows(crawled_places(seeds, pages, keywords))


def crawl_site_text(seeds: DataFrame, pages: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Traverse the stored pages from every seed and return each site's cleaned text."""
    return site_text(crawled_places(seeds, pages, keywords))
