"""Budgeted walk through the link tables of many sites at once.

Each start page of a site is one small row: the URLs still to try, the pages visited and the log of
attempts. A round advances every walk as far as the pages it has already looked up allow, then runs
ahead: it goes on as if every unknown page were fine and had no links, and looks up all pages it meets
that way with one join on ``(site, url)``, at most ``max_pages`` for a walk. So each round learns one
level of every open branch, and a walk takes about as many rounds as it is deep.

The index is a table bucketed by ``(site, url)``: no round shuffles it, only the requests. A hot site
weighs no more than any other in that join, since its pages are spread by URL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.config import ExtractConfig
from sitefacts.functions.regex import first, let, unnest
from sitefacts.operators.links import walk_links
from sitefacts.sources.storage import bucketed, cut_lineage, spread_tasks

DEFAULT = ExtractConfig()

_STEP = "struct<url:string,depth:int>"
_ATTEMPT = "struct<url:string,depth:int,outcome:string>"
_PAGE = "struct<outcome:string,links:array<string>>"
_STATE = (
    f"struct<queue:array<{_STEP}>,visited:array<string>,log:array<{_ATTEMPT}>,"
    "done:boolean,waiting:boolean>"
)
#: A walk that runs ahead: what it would try, and the unknown pages it met.
_AHEAD = f"struct<queue:array<{_STEP}>,visited:array<string>,asked:array<string>,done:boolean>"


def _state(queue: Column, visited: Column, log: Column, done: Column, waiting: Column) -> Column:
    return F.struct(
        queue.alias("queue"), visited.alias("visited"), log.alias("log"),
        done.alias("done"), waiting.alias("waiting"),
    ).cast(_STATE)


def _children(page: Column, head: Column, visited: Column, cfg: ExtractConfig) -> Column:
    """Steps from a visited page to its first links that are not visited yet."""
    fresh = F.slice(F.filter(page["links"], lambda u: ~F.array_contains(visited, u)), 1, cfg.links_per_page)
    return F.when(
        head["depth"] < cfg.max_depth,
        F.transform(fresh, lambda u: F.struct(u, head["depth"] + 1).cast(_STEP)),
    ).otherwise(F.array().cast(f"array<{_STEP}>"))


def _unvisited(queue: Column, visited: Column) -> Column:
    return F.filter(queue, lambda s: ~F.array_contains(visited, s["url"]))


def _advance(state: Column, known: Column, cfg: ExtractConfig, order: str) -> Column:
    """Try the head of the queue; stop when the budget is used up or the head is not looked up yet."""
    no, yes = F.lit(False), F.lit(True)

    def with_queue(queue: Column) -> Column:
        finished = (F.size(queue) == 0) | (F.size(state["visited"]) >= cfg.max_pages)
        return F.when(
            finished, _state(queue, state["visited"], state["log"], yes, no)
        ).otherwise(let(first(queue), lambda head: with_head(queue, head)))

    def with_head(queue: Column, head: Column) -> Column:
        return F.when(
            ~F.map_contains_key(known, head["url"]),
            _state(queue, state["visited"], state["log"], no, yes),
        ).otherwise(
            let(F.element_at(known, head["url"]), lambda page: with_page(queue, head, page))
        )

    def with_page(queue: Column, head: Column, page: Column) -> Column:
        rest = F.slice(queue, 2, F.size(queue))
        attempt = F.struct(head["url"], head["depth"], page["outcome"]).cast(_ATTEMPT)
        log = F.concat(state["log"], F.array(attempt))
        visited = F.concat(state["visited"], F.array(head["url"]))
        children = _children(page, head, visited, cfg)
        queued = F.concat(children, rest) if order == "dfs" else F.concat(rest, children)
        return (
            F.when(page["outcome"] == "ok", _state(queued, visited, log, no, no))
            .when(page["outcome"] == "login", _state(rest, state["visited"], log, yes, no))
            .otherwise(_state(rest, state["visited"], log, no, no))
        )

    unvisited = _unvisited(state["queue"], state["visited"])
    return F.when(state["done"] | state["waiting"], state).otherwise(let(unvisited, with_queue))


def _run_ahead(ahead: Column, known: Column, cfg: ExtractConfig, order: str) -> Column:
    """The same step for a walk that takes unknown pages as fine and without links, and notes them."""

    def state(queue: Column, visited: Column, asked: Column, done: Column) -> Column:
        return F.struct(queue.alias("queue"), visited.alias("visited"), asked.alias("asked"), done.alias("done")).cast(_AHEAD)

    def with_queue(queue: Column) -> Column:
        finished = (F.size(queue) == 0) | (F.size(ahead["visited"]) >= cfg.max_pages)
        stop = state(queue, ahead["visited"], ahead["asked"], F.lit(True))
        return F.when(finished, stop).otherwise(let(first(queue), lambda head: with_head(queue, head)))

    def with_head(queue: Column, head: Column) -> Column:
        rest = F.slice(queue, 2, F.size(queue))
        visited = F.concat(ahead["visited"], F.array(head["url"]))
        asked = F.concat(ahead["asked"], F.array(head["url"]))

        def with_page(page: Column) -> Column:
            children = _children(page, head, visited, cfg)
            queued = F.concat(children, rest) if order == "dfs" else F.concat(rest, children)
            return (
                F.when(page["outcome"] == "ok", state(queued, visited, ahead["asked"], F.lit(False)))
                .when(page["outcome"] == "login", state(rest, ahead["visited"], ahead["asked"], F.lit(True)))
                .otherwise(state(rest, ahead["visited"], ahead["asked"], F.lit(False)))
            )

        return F.when(
            ~F.map_contains_key(known, head["url"]), state(rest, visited, asked, F.lit(False))
        ).otherwise(let(F.element_at(known, head["url"]), with_page))

    return F.when(ahead["done"], ahead).otherwise(let(_unvisited(ahead["queue"], ahead["visited"]), with_queue))


def page_index(facts: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """What a walk needs of a facts table with unique ``(site, url)``: ``page`` = outcome and links it can reach."""
    reached = walk_links(F.col("links"), cfg).alias("links")
    return facts.select("site", "url", F.struct("outcome", reached).alias("page"))


def bucketed_index(
    facts: DataFrame, cfg: ExtractConfig = DEFAULT, more: tuple[str, ...] = (), folder: str | None = None, dealt: bool = False
) -> DataFrame:
    """``page_index`` and the columns ``more`` as a table bucketed by ``(site, url)``; see ``storage.bucketed``."""
    reached = walk_links(F.col("links"), cfg).alias("links")
    rows = facts.select("site", "url", F.struct("outcome", reached).alias("page"), *more)
    return bucketed(rows, "page_index", ["site", "url"], folder, dealt=dealt)


def _no_pages() -> Column:
    return F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{_PAGE}>>"))


def _most_attempts(cfg: ExtractConfig) -> int:
    """Longest possible walk; a round answers at least one attempt, so it bounds the rounds too."""
    return 1 + cfg.max_pages * cfg.links_per_page


@lru_cache(maxsize=8)
def _round_columns(cfg: ExtractConfig, order: str, application: str) -> dict[str, Column]:
    """The columns of a round, built once per session and setting."""
    no = F.lit(False)
    absent = F.struct(F.lit("absent"), F.lit(None).cast("array<string>")).cast(_PAGE)
    found = F.coalesce("answers", _no_pages())
    missing = F.filter("wanted", lambda u: ~F.map_contains_key(found, u))
    started = F.struct(
        F.col("state.queue"), F.col("state.visited"), F.col("state.log"),
        no.alias("done"), no.alias("waiting"),
    ).cast(_STATE)
    ahead = F.struct(
        F.col("state.queue"), F.col("state.visited"), F.array().cast("array<string>").alias("asked"),
        F.col("state.done"),
    ).cast(_AHEAD)
    steps = F.sequence(F.lit(1), F.lit(_most_attempts(cfg) + 1))
    return {
        "answers": F.map_from_entries(F.collect_list(F.struct("url", F.col("page").cast(_PAGE)))),
        "looked_up": F.map_concat(
            "known", found, F.map_from_arrays(missing, F.transform(missing, lambda _: absent))
        ),
        "walked": F.aggregate(steps, started, lambda s, _: _advance(s, F.col("known"), cfg, order)),
        "wanted": F.array_distinct(
            F.aggregate(steps, ahead, lambda s, _: _run_ahead(s, F.col("known"), cfg, order), lambda s: s["asked"])
        ),
        "kept": F.map_filter("known", lambda u, _: ~F.array_contains("state.visited", u)),
    }


def answers(state: DataFrame, index: DataFrame, cfg: ExtractConfig = DEFAULT, order: str = "dfs") -> DataFrame:
    """The pages that walks want: ``site, seed, answers`` with a map from URL to page.

    An inner join on the keys of the index: a bucketed index is not shuffled, the requests are.
    """
    columns = _round_columns(cfg, order, state.sparkSession.sparkContext.applicationId)
    requests = state.select("site", "seed", F.explode("wanted").alias("url"))
    return requests.join(index, ["site", "url"]).groupBy("site", "seed").agg(columns["answers"].alias("answers"))


def crawl_attempts(
    seeds: DataFrame, index: DataFrame, cfg: ExtractConfig = DEFAULT, order: str = "dfs"
) -> DataFrame:
    """Every fetch attempt of every walk in order: ``site, seed, attempt, url, depth, outcome``.

    Each row of ``seeds`` is a walk of its own, named by its start page ``seed``.

    ``order='dfs'`` follows a page's links before its siblings, ``'bfs'`` goes level by level; they
    visit different pages when the budget binds. A page outside the corpus has outcome ``absent``:
    it uses a link slot but no budget. Failed pages may be tried again from another page.
    """
    if order not in ("dfs", "bfs"):
        raise ValueError(f"unknown order: {order}")
    no, no_pages = F.lit(False), _no_pages()
    columns = _round_columns(cfg, order, seeds.sparkSession.sparkContext.applicationId)
    start = F.array(F.struct(F.col("url"), F.lit(0)).cast(_STEP))
    nothing = F.array().cast("array<string>")
    state = seeds.select(
        "site",
        F.col("url").alias("seed"),
        _state(start, nothing, F.array().cast(f"array<{_ATTEMPT}>"), no, no).alias("state"),
        no_pages.alias("known"),
    ).withColumn("wanted", F.transform("state.queue", lambda s: s["url"]))
    finished: list[DataFrame] = []
    # a round works long on few bytes, so the size of its tasks isn't left to adaptive execution
    tasks = spread_tasks(seeds, waves=1)

    for _ in range(_most_attempts(cfg) + 1):
        state = (
            state.join(answers(state, index, cfg, order), ["site", "seed"], "left")
            .select("site", "seed", "state", columns["looked_up"].alias("known"))
            .repartition(tasks, "site", "seed")
            .select("site", "seed", columns["walked"].alias("state"), "known")
            .select("site", "seed", "state", columns["kept"].alias("known"), columns["wanted"].alias("wanted"))
        )
        state = cut_lineage(state)
        finished.append(state.filter("state.done").select("site", "seed", "state.log"))
        state = state.filter("NOT state.done")
        if state.isEmpty():
            break
    else:
        raise RuntimeError("a walk goes on beyond its bound of rounds")

    logs = finished[0]
    for more in finished[1:]:
        logs = logs.unionByName(more)
    return unnest(logs, "log", "attempt", "entry").select("site", "seed", "attempt", "entry.*")


def crawl_frontier(
    seeds: DataFrame, index: DataFrame, cfg: ExtractConfig = DEFAULT, order: str = "dfs"
) -> DataFrame:
    """Visited pages only: ``site, seed, seq, url, depth`` with ``seq`` from 0 in visiting order."""
    return visits(crawl_attempts(seeds, index, cfg, order))


def visits(attempts: DataFrame) -> DataFrame:
    """Successful attempts, renumbered; a walk has ``max_pages`` of them at most."""
    ok = attempts.filter(F.col("outcome") == "ok")
    ordered = ok.groupBy("site", "seed").agg(
        F.array_sort(F.collect_list(F.struct("attempt", "url", "depth"))).alias("pages")
    )
    return unnest(ordered, "pages", "seq", "page").select("site", "seed", "seq", "page.url", "page.depth")
