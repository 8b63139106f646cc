"""The four entry points as functions, and their command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions.taxonomy import NATIVE, NATIVE_PHRASES, NATIVE_VARIANTS, Taxonomy, Variant
from scriptorium.operators import biblio, canvas, concepts, sensitivity
from scriptorium.plans.page import html_page
from scriptorium.session import cut, ship_package
from scriptorium.sources import corpus, extractors, sinks

Extractor = Callable[[bytes], list[str]]


def load_documents(spark: SparkSession, folder: str | None = None, cache: str | None = None, readers: Iterable[Extractor] = (), workers: int | None = None) -> DataFrame:
    """(path, pages): the cache where it exists, else the files of a folder through the extractors."""

    def build() -> DataFrame:
        if not folder or not readers:
            raise ValueError("a folder and an extractor are needed where there is no cache")
        files = corpus.discover(spark, folder)
        return corpus.extract_pages(files.repartition(workers) if workers else files, *readers)

    if cache:
        return corpus.cached_pages(spark, cache, build)
    if not folder:
        raise ValueError("a folder or a cache is needed")
    return build()


def analyse_corpus(documents: DataFrame, output: str, taxonomy: Taxonomy = NATIVE, phrases: Iterable[str] = NATIVE_PHRASES, exclude_list: str | None = None, top_n: int = 40) -> dict[str, DataFrame]:
    """Profiles, histogram, dominance, shortlist and summary of a corpus, written below ``output``."""
    patterns = corpus.checked_patterns(documents.sparkSession, corpus.exclusion_patterns(exclude_list))
    # four reports read the profiles; they are kept in the shared checkpoint folder
    profiled = cut(concepts.profile(corpus.without_excluded(documents, patterns), taxonomy, phrases))
    if profiled.isEmpty():
        raise ValueError("no documents to analyse")
    out = {
        "per_document_results": sinks.per_document_report(profiled, taxonomy),
        f"top_{top_n}_documents": concepts.top_documents(profiled, top_n).select("rank", "filename", "total_hits", "breadth", "dominant_frame", "path"),
        "breadth_histogram": concepts.breadth_histogram(profiled),
        "frame_dominance": concepts.frame_dominance(profiled, taxonomy),
        "summary": concepts.summary(profiled, taxonomy),
    }
    for name, df in out.items():
        if name == "summary":
            sinks.write_text(df, "summary", f"{output}/{name}.json")
        else:
            sinks.write_csv(df, f"{output}/{name}.csv", single=name != "per_document_results")
    return out


def analyse_sensitivity(documents: DataFrame, output: str, variants: tuple[Variant, ...] = NATIVE_VARIANTS) -> DataFrame:
    """The matrix over the variants, one line each, written as a CSV file."""
    frames = variants[0].taxonomy.frame_order
    report = sensitivity.sensitivity_report(sensitivity.sensitivity_matrix(documents, variants), frames)
    sinks.write_csv(report, output, single=True)
    print("\n".join(sinks.console_table(report, {"variant": 26, **{f"{f}_pct": 16 for f in frames}, "zero_engagement_pct": 20, "n_docs": 8})))
    return report


def analyse_bibliography(documents: DataFrame, output: str) -> dict[str, DataFrame]:
    """Entries, works and authors by popularity, and coverage, written below ``output``."""
    parsed = cut(biblio.entries(documents))
    out = {
        "per_document_entries": parsed.drop("entry_no"),
        "most_cited_works": biblio.by_popularity(biblio.most_cited_works(parsed), parsed, ["surname", "year"]),
        "most_cited_authors": biblio.by_popularity(biblio.most_cited_authors(parsed), parsed, ["surname"]),
        "coverage": biblio.coverage(documents, parsed),
    }
    for name, df in out.items():
        sinks.write_csv(df, f"{output}/{name}.csv", single=name == "coverage")
    return out


def export_canvas(
    spark: SparkSession, path: str, output: str, vault: str | None = None, scale: float = 2.0, theme: str = "light", padding: int = canvas.PADDING, dots: bool = False, tile: int = canvas.DEFAULT_TILE, preview: int = canvas.PREVIEW,
    offline: bool = False, renderer: Callable[[str], str] | None = None, tiles_dir: str | None = None, html_only: bool = False, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The page of a canvas and the manifest of its tiles, written below ``output`` (the manifest below ``tiles_dir``).

    With ``html_only`` the page alone is written, with ``dry_run`` nothing. A picture beyond the format's size is an
    error where tiles are asked for.
    """
    nodes, edges = corpus.read_canvas(spark, path)
    root = str(Path(vault or corpus.vault_root(path)).resolve())
    found = corpus.vault_files(spark, root)
    files = found.select("path", "walk_ord", F.when(F.lower("path").endswith(".md"), corpus.note_text(F.col("content"))).alias("text"))
    page = cut(html_page(nodes, edges, files, theme, padding, dots, not offline, renderer, f"file://{root}"))
    plan = canvas.tile_plan(page.select("width", "height"), scale, tile, preview)
    size = plan.select("width", "height", "out_width", "out_height").first()
    if size is None:
        raise ValueError("the canvas has no nodes")
    print(f"{size.width} x {size.height} units, {size.out_width} x {size.out_height} pixels at scale {scale}")
    manifest = canvas.tile_manifest(plan, scale)
    if html_only or not dry_run:
        sinks.write_text(page, "html", f"{output}/page.html")
    if not html_only and not dry_run:
        if max(size.out_width, size.out_height) > canvas.MOST_PIXELS:
            raise ValueError("the picture is larger than the format allows; take a smaller scale")
        sinks.write_csv(manifest, f"{tiles_dir or output}/tiles.csv")
    return page, manifest


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, output in (("corpus", "results"), ("sensitivity", "sensitivity_results"), ("bibliography", "bibliography_results")):
        command = commands.add_parser(name)
        command.add_argument("--corpus-dir", help="folder of PDF files, read by an installed PDF library")
        command.add_argument("--cache-file", help="extraction cache of JSON lines; written there first if it is not there yet")
        command.add_argument("--output", "--output-dir", dest="output", default=output)
        command.add_argument("--workers", type=int, help="tasks that read files side by side; by default as many as there are cores")
        if name == "corpus":
            command.add_argument("--exclude-list")
            command.add_argument("--top-n", type=int, default=40)
            command.add_argument("--no-plots", action="store_true", help="without effect: the data of the charts are written, and none is drawn")
    command = commands.add_parser("canvas")
    command.add_argument("canvas")
    command.add_argument("-o", "--output")
    command.add_argument("--vault")
    command.add_argument("-s", "--scale", type=float, default=2.0)
    command.add_argument("--theme", choices=sorted(canvas.THEMES), default="light")
    command.add_argument("--padding", type=int, default=canvas.PADDING)
    command.add_argument("--dots", action="store_true")
    command.add_argument("--tile", type=int, default=canvas.DEFAULT_TILE)
    command.add_argument("--preview", type=int, default=canvas.PREVIEW)
    command.add_argument("--tiles-dir", help="folder for the manifest of the tiles")
    command.add_argument("--offline", action="store_true")
    command.add_argument("--html-only", action="store_true")
    command.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    ship_package(spark)
    if args.command == "canvas":
        export_canvas(spark, args.canvas, args.output or str(Path(args.canvas).with_suffix("")), args.vault, args.scale, args.theme, args.padding, args.dots, args.tile, args.preview, args.offline, tiles_dir=args.tiles_dir, html_only=args.html_only, dry_run=args.dry_run)
        return
    documents = load_documents(spark, args.corpus_dir, args.cache_file, extractors.installed() if args.corpus_dir else (), args.workers)
    if args.command == "corpus":
        analyse_corpus(documents, args.output, exclude_list=args.exclude_list, top_n=args.top_n)
    elif args.command == "sensitivity":
        analyse_sensitivity(documents, args.output)
    else:
        analyse_bibliography(documents, args.output)


if __name__ == "__main__":
    main()
