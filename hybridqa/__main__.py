"""python -m hybridqa KB.json [--mode direct|scored] [--config FILE] [--json] [UTTERANCE...]: answers each utterance, or lines of standard input until an empty one."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from hybridqa.config import Config, load
from hybridqa.plans.answer import build_index
from hybridqa.sources.kb import read_kb
from hybridqa.streaming.answers import Service


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hybridqa", description="Answers utterances from a knowledge base.")
    parser.add_argument("kb")
    parser.add_argument("utterances", nargs="*")
    parser.add_argument("--mode", choices=("direct", "scored"), default="direct")
    parser.add_argument("--config")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    cfg = load(args.config) if args.config else Config()
    service = Service(build_index(read_kb(SparkSession.builder.getOrCreate(), args.kb), cfg), cfg, args.mode)
    for text in args.utterances or iter(sys.stdin.readline, ""):
        if not text.strip():
            break
        got = service.answer_one(text.rstrip("\n"))
        print(json.dumps(got, ensure_ascii=False) if args.json else f"{got['answer']}\n  [{got['confidence_tier']}] {got['chosen_qa_id'] or got['fallback_reason']} {got['latency_s']:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
