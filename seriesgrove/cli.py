"""Commands: index, query, find, sort, show, autopipeline, nnunet, testdata.  ``python -m seriesgrove.cli COMMAND -h``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import util
from .functions import nested
from .functions.strings import natural_sort_key
from .operators import forest, outputs, roi
from .plans import nnunet, pipeline, validators
from .sources import dicom, files, remote, render


def roi_map(pairs: list[str] | None, yaml_path: str | None = None) -> dict[str, list[str]] | None:
    """``key:pat1,pat2`` options over a YAML file of key: [patterns]; options win."""
    out = read_yaml(yaml_path) if yaml_path else {}
    for p in pairs or []:
        key, sep, rest = p.partition(":")
        if not sep or not key or not rest:
            raise ValueError(f"a region map is key:pattern,pattern, not {p!r}")
        out[key] = rest.split(",")
    return out or None


def read_yaml(path: str) -> dict[str, list[str]]:
    """A mapping of names to a text or a list of texts, the part of YAML that region maps use."""
    out: dict[str, list[str]] = {}
    key = None
    plain = lambda s: s.strip().strip("'\"")
    with open(path, encoding="utf-8") as f:
        for line in f:
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            if bare.lstrip().startswith("- "):
                if key is None:
                    raise ValueError(f"{path}: a list item without a name")
                out[key].append(plain(bare.lstrip()[2:]))
                continue
            key, sep, rest = bare.partition(":")
            if not sep:
                raise ValueError(f"{path}: {bare!r} is no name: pattern")
            key, rest = plain(key), rest.strip()
            out[key] = [plain(x) for x in rest[1:-1].split(",") if x.strip()] if rest.startswith("[") else [plain(rest)] if rest else []
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seriesgrove", description=__doc__)
    p.add_argument("-v", "--verbose", action="store_true")
    every = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return every.add_parser(name, help=about, description=about)

    c = command("index", "Crawls a directory into an index.")
    c.add_argument("--dicom-dir", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--n-jobs", type=int, default=-1)
    c.add_argument("--force", action="store_true")
    c = command("query", "Samples of an index or a directory that hold the asked modalities.")
    c.add_argument("path")
    c.add_argument("-q", "--query", default="*")
    c.add_argument("--output-dir")
    c.add_argument("--tree", action="store_true", help="prints the series as a tree")
    c.add_argument("--html", help="writes the tree to this file")
    c.add_argument("--no-group", action="store_true", help="a row per path, not per root")
    c.add_argument("--force", action="store_true")
    c = command("find", "Finds DICOM files.")
    c.add_argument("path")
    c.add_argument("search", nargs="*")
    c.add_argument("--extension", default="dcm")
    c.add_argument("--check-header", action="store_true")
    c.add_argument("--count", action="store_true")
    c.add_argument("--limit", type=int)
    c.add_argument("--sort", action="store_true")
    c = command("sort", "Sorts files by a pattern of header fields.")
    c.add_argument("source")
    c.add_argument("pattern")
    c.add_argument("target")
    c.add_argument("--action", default="copy", choices=("move", "copy", "symlink", "hardlink"))
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--truncate-uids", type=int, default=5)
    c = command("show", "Shows a file's header, or a part of it: FILE::A.B[0].(0010,0020).")
    c.add_argument("file")
    for name, about in (("autopipeline", "Directory to NIfTI files."), ("nnunet", "Directory to a training dataset.")):
        c = command(name, about)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--modalities", default=None if name == "autopipeline" else "CT,RTSTRUCT")
        c.add_argument("--existing-file-mode", default="fail", choices=("fail", "skip", "overwrite"))
        c.add_argument("--update-crawl", action="store_true")
        c.add_argument("--spacing", type=validators.spacing, default=(1.0, 1.0, 0.0) if name == "autopipeline" else (0.0, 0.0, 0.0))
        c.add_argument("--window-width", type=float)
        c.add_argument("--window-level", type=float)
        c.add_argument("--roi-ignore-case", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("--roi-allow-multi-matches", action=argparse.BooleanOptionalAction, default=True)
        c.add_argument("-rmap", "--roi-match-map", action="append", metavar="KEY:PAT,PAT")
        c.add_argument("--roi-match-yaml")
        if name == "autopipeline":
            c.add_argument("--filename-format", default=pipeline.DEFAULT_FORMAT)
            c.add_argument("--roi-strategy", default="merge", choices=[s.value for s in roi.ROIMatchStrategy])
            c.add_argument("--roi-on-missing-regex", default="ignore", choices=[s.value for s in roi.ROIMatchFailurePolicy])
        else:
            c.add_argument("--mask-saving-strategy", default="label", choices=[s.value for s in nnunet.MaskSavingStrategy])
    c = command("testdata", "Downloads the assets of a release.")
    c.add_argument("release")
    c.add_argument("--dest", default="data")
    c.add_argument("--assets", nargs="*")
    c.add_argument("--list-assets", action="store_true")
    c.add_argument("--token")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    log = util.logger(level="INFO" if a.verbose else "WARNING")
    say = lambda *x: print(*x)  # noqa: E731, T201
    if a.command == "show":
        say(json.dumps(show(a.file), indent=2, default=dicom.text))
        return 0
    if a.command == "testdata":
        found = [x for x in remote.assets(a.release, a.token) if not a.assets or x.name in a.assets]
        say("\n".join(x.name for x in found) if a.list_assets else json.dumps(remote.download(found, a.dest, a.token), indent=2))
        return 0
    n = f"local[{validators.jobs(getattr(a, 'n_jobs', -1))}]"
    spark = spark or SparkSession.builder.appName("seriesgrove").config("spark.sql.session.timeZone", "UTC").config("spark.master", n).getOrCreate()
    with util.timed(a.command, log.info):
        return {"index": _index, "query": _query, "find": _find, "sort": _sort, "autopipeline": _pipeline, "nnunet": _nnunet}[a.command](spark, a, say)


def show(target: str) -> object:
    """A header as a mapping, or the value at ``FILE::path``; a missing part is null."""
    path, _, inner = target.partition("::")
    from .storage import read_bytes

    value: object = dicom.parse(read_bytes(path))
    for name, tag, index in nested.steps(inner):
        if index is not None:
            value = value[index] if isinstance(value, list) and index < len(value) else None
        else:
            value = value.get(dicom.name_of(tag) if tag else name) if isinstance(value, dict) else None
    return value


def _index(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    c = pipeline.Crawler(spark, a.dicom_dir, a.output_dir, a.force)
    n = c.index().count()
    pipeline.Crawler(spark, a.dicom_dir, a.output_dir).write_sinks()
    say(f"{n} series")
    return 0


def _query(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    source = a.path if a.path.endswith(".csv") else pipeline.Crawler(spark, a.path, a.output_dir or a.path.rstrip("/") + "/.crawl", a.force).index()
    tree = pipeline.forest_of(pipeline.load_index(spark, source))
    found = tree.query(a.query)
    if a.tree or a.html:
        rows = render.tree_rows(tree.nodes, tree.paths())
        if a.tree:
            say(render.tree_text(rows))
        if a.html:
            with open(a.html, "w", encoding="utf-8") as f:
                f.write(render.tree_html(rows))
    if not a.no_group:
        found = forest.group_by_root(found).select("pid", F.concat(F.array("first"), "others").alias("members"))
    for r in found.select("pid", forest.members_text("members").alias("m")).orderBy("pid", "m").toLocalIterator():
        say(f"{r.pid}\t{r.m}")
    return 0


def _find(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    found = files.find_dicoms(spark, a.path, check_header=a.check_header, extension=a.extension, limit=a.limit, search_input=a.search or None).select("path")
    if a.count:
        say(found.count())
        return 0
    for r in (found.orderBy(natural_sort_key(F.col("path"))) if a.sort else found).toLocalIterator():
        say(r.path)
    return 0


def _sort(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    out = pipeline.sort_files(spark, a.source, a.pattern, a.target, a.action, a.overwrite, a.dry_run, a.truncate_uids)
    if a.dry_run:
        for r in outputs.unique_children(out, "target").orderBy("depth").collect():  # a row per level
            say(f"level {r.depth}: {r.n_unique}")
        return 0
    bad = out.where("error is not null")
    for r in bad.toLocalIterator():
        say(f"{r.source}: {r.error}")
    return int(not bad.isEmpty())


def _pipeline(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    p = pipeline.Autopipeline(
        spark, a.input, a.output, a.filename_format, a.existing_file_mode, validators.modalities(a.modalities), a.spacing, a.window_width, a.window_level, roi_map(a.roi_match_map, a.roi_match_yaml),
        roi.ROIMatchStrategy(a.roi_strategy), a.roi_ignore_case, a.roi_allow_multi_matches, roi.ROIMatchFailurePolicy(a.roi_on_missing_regex), a.update_crawl,
    )
    say(json.dumps(p.write_reports(p.run())))
    return 0


def _nnunet(spark: SparkSession, a: argparse.Namespace, say) -> int:  # noqa: ANN001
    p = nnunet.NNUNetPipeline(
        spark, a.input, a.output, validators.modalities(a.modalities) or [], roi_map(a.roi_match_map, a.roi_match_yaml), a.mask_saving_strategy, a.existing_file_mode, a.spacing, a.window_width,
        a.window_level, a.roi_ignore_case, a.roi_allow_multi_matches, a.update_crawl,
    )
    say(pipeline.report(p.run()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
