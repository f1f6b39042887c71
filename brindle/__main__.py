"""python -m brindle --folder=DIR (--query=SQL | --serve=PORT | --serve-pg=PORT | both servers)"""

from __future__ import annotations

import argparse
import sys
import threading

from pyspark.sql import SparkSession

from brindle.errors import EngineError
from brindle.serving.postgres import PostgresServer
from brindle.serving.text import Sessions, TextServer, lines
from brindle.session import Engine


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--folder")
    p.add_argument("--query")
    p.add_argument("--serve", type=int)
    p.add_argument("--serve-pg", type=int)
    o = p.parse_args(args)
    engine = Engine(SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate(), o.folder)
    if o.query is not None:
        try:
            sys.stdout.writelines(lines(engine.sql(o.query)))
        except EngineError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    sessions = Sessions(engine)
    servers = [kind(sessions, port) for kind, port in ((TextServer, o.serve), (PostgresServer, o.serve_pg)) if port is not None]
    if not servers:
        p.error("give a query or a port")
    threads = [threading.Thread(target=s.serve_forever) for s in servers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return 0


if __name__ == "__main__":
    sys.exit(main())
