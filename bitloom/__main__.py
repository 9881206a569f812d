"""python -m bitloom -e PROGRAM | -f FILE | --repl | (program on stdin): runs postfix programs, prints the stack as JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from bitloom.plans.element import Session
from bitloom.plans.forth import Interpreter, parse, shown


def main(args: list[str]) -> int:
    args = [a for a in args if a != "--forth"]
    if args[:1] in (["-h"], ["--help"]):
        print(__doc__)
        return 0
    if args[:1] == ["--forth-debug"]:
        print(" ".join(map(str, parse(args[1]))))
        return 0
    spark = SparkSession.builder.appName("bitloom").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = Session(spark)
    if args[:1] in (["-r"], ["--repl"]) or (not args and sys.stdin.isatty()):
        machine = Interpreter(session)
        for line in sys.stdin:
            try:
                print(json.dumps(shown(machine.run(line))), flush=True)
            except Exception as e:  # noqa: BLE001
                print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 0
    try:
        if args[:1] == ["-f"]:
            with open(args[1]) as f:
                source = f.read()
        else:
            source = args[1] if args[:1] == ["-e"] else args[0] if args else sys.stdin.read()
        print(json.dumps(shown(Interpreter(session).run(source))))
        return 0
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
