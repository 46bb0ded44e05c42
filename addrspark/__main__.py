"""python -m addrspark: search, reverse and the care of a dictionary from the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from . import __version__
from .errors import AddressError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("addrspark")
    p.add_argument("-v", "--version", action="version", version=__version__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, where: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("-d", "--debug", action="store_true", help="log what is done")
        if where:
            c.add_argument("--db-dir", "--nodes", dest="folder", help="folder of the gazetteer")
            c.add_argument("--url", help="address of a server")
            c.add_argument("--namespace", default="", help="name that the server's methods begin with")
        return c

    c = command("search", "print what an address matches, as JSON")
    c.add_argument("--area", default="", help="names or codes of areas, with commas between them")
    c.add_argument("address")
    c = command("reverse", "print up to three addresses around a point, as JSON")
    c.add_argument("--level", type=int, default=6)
    c.add_argument("longitude", type=float)
    c.add_argument("latitude", type=float)
    command("get-db-dir", "print the dictionary's folder", False)
    c = command("download-dictionary", "fetch a packed dictionary into this folder", False)
    c.add_argument("url")
    c = command("install-dictionary", "install a packed dictionary, or the node table of a SQLite file")
    c.add_argument("-y", "--yes", action="store_true", help="replace an installed one without asking")
    c.add_argument("path")
    command("uninstall-dictionary", "delete the dictionary")
    command("list-datasets", "print the data sets of the dictionary, as JSON")
    return p


def run(spark: SparkSession, given: argparse.Namespace):
    """What a command answers."""
    from . import session
    from .sources import dictionary

    if given.command == "get-db-dir":
        return session.locate()
    if given.command == "download-dictionary":
        return dictionary.download(given.url, os.getcwd())
    if given.command == "install-dictionary":
        folder = given.folder or session.locate("w")
        if os.path.exists(os.path.join(folder, "nodes")) and not given.yes and not input("Replace the installed dictionary? (y/N) ").lower().startswith("y"):
            return None
        made = {"nodes": dictionary.install(spark, given.path, f"{folder}/nodes")} if given.path.endswith((".db", ".sqlite")) else dictionary.install_archive(spark, given.path, folder)
        session.Local(spark, folder).prepare()
        return made
    if given.command == "uninstall-dictionary":
        folder = given.folder or session.locate()
        if folder:
            dictionary.uninstall(spark, folder)
        return folder
    values = {"target_area": given.area} if getattr(given, "area", "") else {}
    g = session.connect(spark, given.folder, given.url, namespace=given.namespace, **values)
    if given.command == "search":
        return g.search("".join(given.address.split()))
    if given.command == "reverse":
        return g.reverse(given.longitude, given.latitude, given.level)
    return g.datasets()


def main(args: list[str] | None = None) -> None:
    given = parser().parse_args(args)
    if given.debug:
        logging.basicConfig(level=logging.DEBUG)
    try:
        answer = run(SparkSession.builder.appName("addrspark").getOrCreate(), given)
    except AddressError as e:
        sys.exit(f"{type(e).__name__}: {e}")
    print(answer if answer is None or isinstance(answer, str) else json.dumps(answer, ensure_ascii=False))


if __name__ == "__main__":
    main()
