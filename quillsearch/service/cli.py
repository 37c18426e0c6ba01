"""Command line: import, embed, compress, serve, or search interactively."""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
import tempfile
import webbrowser
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

from ..embed import providers
from ..operators.store import Engine
from ..sources import releases
from .app import App, Config


def parse(args: list[str] | None = None) -> Config:
    parser = argparse.ArgumentParser(prog="quillsearch", description="Local hybrid search on Spark.")
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=type(f.default), default=f.default)
    return Config(**vars(parser.parse_args(args)))


def repl(app: App, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
    """A query lists results; a number opens one of them; an empty line ends."""
    known: dict[int, int] = {}
    while True:
        try:
            query = ask("> ").strip()
        except EOFError:
            return
        if not query:
            return
        if query.isdigit() and int(query) in known:
            a = app.article(known[int(query)])
            say(a["title"])
            for s in a["sections"]:
                say(s["title"])
                say(s["content"])
            continue
        known = {}
        for i, r in enumerate(app.search(query, app.config.limit), 1):
            known[i] = r.get("article_id", 0)
            power = f" [{r['power']:.0f}]" if app.config.log else ""
            say(f"{i:3d} [{r.get('type', '')}]{power} {r.get('title', '')}")


def wizard(ask: Callable[[str], str] = input) -> Config:
    """Without arguments: ask what to do."""
    config = Config()
    if path := ask("Import archive (path or URL, empty for none): ").strip():
        config.wiki_import = path
    config.web = ask("Serve the web interface? [y/N] ").strip().lower().startswith("y")
    config.cli = not config.web
    return config


def model_path(engine: Engine) -> str | None:
    """Where this machine has the store's model; of a shared store a copy is made once.

    Workers load the model from the same path, so on a cluster it goes to them as a file
    of the job."""
    folder = engine.folder
    if not folder.exists("model.gguf"):
        return None
    if "://" not in engine.path:
        return f"{engine.path}/model.gguf"
    target = os.path.join(tempfile.mkdtemp(prefix="model-"), "model.gguf")
    with folder.fs.open_input_stream(f"{folder.root}/model.gguf") as model, open(target, "wb") as out:
        shutil.copyfileobj(model, out)
    engine.spark.sparkContext.addFile(target)
    return target


def prepare(spark: SparkSession, config: Config) -> App:
    """Open the store and do what the flags ask for: setup, model, import, vectors, compression."""
    if config.setup:
        # parts of a packed store, named as *.db.gz or *.db-1.gz …
        paths = config.setup.split(",")
        target = f"{config.db}.tar"
        releases.join_parts(paths, target)
        shutil.unpack_archive(target, config.db)
    writes = bool(config.wiki_import or config.ai_sync or config.db_compress or config.ai_model_import)
    engine = Engine.open(spark, config.db, True if writes else None)
    if config.ai_model_import:
        with open(config.ai_model_import, "rb") as model, engine.folder.sink("model.gguf") as (out, _):
            shutil.copyfileobj(model, out)
    if config.wiki_import:
        engine.ingest(config.wiki_import, config.language)
    for key, name, kind in (("language", "language", str), ("aiModelPrefixSearch", "ai_model_prefix_search", str), ("aiModelPrefixSave", "ai_model_prefix_save", str), ("aiModel", "ai_model", str), ("aiAnnSize", "ai_ann_size", int)):
        try:
            setattr(config, name, kind(engine.get(key).decode()))
        except KeyError:
            pass
    path = model_path(engine)
    embed = providers.provider(config.ai_api, config.ai_api_url, config.ai_model, config.ai_api_key, path, config.ai_cache)
    app = App(engine, config, embed)
    if config.ai_sync and embed:
        for key, value in (("aiModel", config.ai_model), ("aiModelPrefixSave", config.ai_model_prefix_save), ("aiModelPrefixSearch", config.ai_model_prefix_search)):
            engine.put(key, value)
        engine.sync_vectors(lambda rows: providers.over(rows, embed), config.ai_model_prefix_save, config.ai_ann, config.ai_ann_size)
    if config.db_compress:
        engine.compress()
    return app


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    config = parse(args) if args else wizard()
    if config.log:
        logging.basicConfig(level=logging.INFO, filename=config.log_file or None)
    spark = SparkSession.builder.appName("quillsearch").getOrCreate()
    app = prepare(spark, config)
    if config.cli:
        repl(app)
    if config.web:
        from .web import server

        with server(app) as http:
            if config.web_browser:
                webbrowser.open(f"http://{config.web_host}:{config.web_port}")
            http.serve_forever()


if __name__ == "__main__":
    main()
