"""python -m tallymark run CONFIG.json [-o SCRIPT] [-d FOLDER], or template [FOLDER]."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .plans.config import Config, template
from .session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallymark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a configuration")
    run.add_argument("config")
    run.add_argument("-o", "--output-script", help="write an equal Python script")
    run.add_argument("-d", "--folder", default=".", help="where reports and rules go")
    blank = commands.add_parser("template", help="write a configuration to fill in")
    blank.add_argument("folder", nargs="?", default=".")
    own = parser.parse_args(args)
    try:
        if own.command == "template":
            os.makedirs(own.folder, exist_ok=True)
            with open(os.path.join(own.folder, "scorecard.json"), "w") as file:
                json.dump(template(), file, indent=2)
            return 0
        config = Config.load(own.config)
        if own.output_script:
            with open(own.output_script, "w") as file:
                file.write(config.script())
        config.execute(local_session(), own.folder)
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
