"""Command line: inspect, extract, score, export, eval."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from timbre.config import Config
from timbre.session import local_session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="timbre", description="Speaker-voice analytics on Spark.")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor", help="what is installed and how the session is set")
    for name, text in (("inspect", "speakers of a corpus"), ("extract", "a voice profile")):
        p = sub.add_parser(name, help=text)
        p.add_argument("path")
        p.add_argument("--format")
        if name == "extract":
            p.add_argument("--target", action="append")
            p.add_argument("--reference", action="append")
            p.add_argument("--out", default="out")
            p.add_argument("--config")
            p.add_argument("--public", action="store_true")
            p.add_argument("--max-target", type=int)
    p = sub.add_parser("score", help="score texts with the scorer of a voice.json")
    p.add_argument("voice")
    p.add_argument("texts", nargs="+")
    p = sub.add_parser("ts-lib", help="the scorer for another runtime")
    p.add_argument("voice")
    p.add_argument("--out", default="voiceScorer.ts")
    p = sub.add_parser("eval", help="planted, attribution or curve")
    p.add_argument("kind", choices=["planted", "attribution", "curve"])
    p.add_argument("--path")
    p.add_argument("--format")
    p.add_argument("--speaker")
    p.add_argument("--sizes", type=int, nargs="+", default=[25, 50, 100, 200, 400, 800, 1600])
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = local_session("timbre-cli", cpus="*")
    from timbre.operators import corpus, scorer
    from timbre.plans import evaluate, extract
    from timbre.sources.readers import read_turns

    if args.command == "doctor":
        print(json.dumps({"spark": spark.version, "master": spark.sparkContext.master, "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None)}, indent=2))
    elif args.command == "inspect":
        for r in corpus.speakers(read_turns(spark, args.path, args.format)).limit(50).collect():
            print(f"{r.n:>8}  {r.speaker}")
    elif args.command == "extract":
        cfg = Config.load(args.config) if args.config else Config()
        result = extract.run(read_turns(spark, args.path, args.format), cfg, targets=args.target, reference=args.reference, public=args.public, max_target=args.max_target)
        result.write(args.out)
        print(f"{len(result.data['rules'])} rules, {len(result.exemplars)} exemplars in {args.out}")
    elif args.command in ("score", "ts-lib"):
        model = json.loads(Path(args.voice).read_text(encoding="utf-8"))["scorer"]
        if args.command == "ts-lib":
            Path(args.out).write_text(scorer.to_typescript(model), encoding="utf-8", newline="\n")
        else:
            df = spark.createDataFrame(list(enumerate(args.texts)), "i int, text string")
            for r in scorer.score_texts(df, model).orderBy("i").collect():
                print(f"{r.score:.3f}  {r.text}")
    else:
        if args.kind == "planted":
            out = evaluate.planted(spark)
        else:
            turns = read_turns(spark, args.path, args.format)
            out = evaluate.attribution(turns) if args.kind == "attribution" else evaluate.curve(turns, args.speaker or corpus.most_frequent_speaker(turns), args.sizes)
        print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
