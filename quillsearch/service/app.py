"""What the HTTP API, the tool endpoint and the command line share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..embed.providers import Provider
from ..operators.store import Engine

NAME, VERSION = "quillsearch", "0.1.0"


@dataclass
class Config:
    ai_ann: bool = False
    ai_ann_size: int = 64
    ai_api: bool = False
    ai_api_key: str = ""
    ai_api_url: str = "http://localhost:8080/v1/embeddings"
    ai_cache: bool = False
    ai_model: str = "Qwen3-Embedding-0.6B-Q8_0"
    ai_model_import: str = ""
    ai_model_prefix_save: str = ""
    ai_model_prefix_search: str = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"
    ai_threads: int = 0
    ai_sync: bool = False
    cli: bool = False
    db: str = "quillsearch.store"
    db_compress: bool = False
    language: str = "en"
    limit: int = 10
    log: bool = False
    log_file: str = ""
    setup: str = ""
    web: bool = False
    web_browser: bool = False
    web_host: str = "localhost"
    web_port: int = 35248
    web_tls_private: str = ""
    web_tls_public: str = ""
    wiki_import: str = ""


class ApiError(Exception):
    def __init__(self, message: str, status: int):
        super().__init__(message)
        self.status = status


@dataclass
class App:
    engine: Engine
    config: Config = field(default_factory=Config)
    embed: Provider | None = None

    @property
    def ai(self) -> bool:
        return self.embed is not None

    def vector(self, query: str) -> list[float] | None:
        return self.embed([self.config.ai_model_prefix_search + query])[0] if self.embed else None

    def rows(self, found) -> list[dict]:
        """Results as JSON objects: zero ids and empty titles and types are left out."""
        out = []
        for r in found.collect():
            one = {k: v for k, v in (("article_id", r["article_id"]), ("title", r["title"])) if v}
            one["text"] = r["text"]
            if r["type"]:
                one["type"] = r["type"]
            out.append(one | {"power": r["power"], "snippet": r["snippet"]})
        return out

    def checked(self, query: str, limit: int) -> None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        if not query.strip():
            raise ValueError("the query is empty")

    def search(self, query: str, limit: int) -> list[dict]:
        self.checked(query, limit)
        return self.rows(self.engine.search(query, limit, self.vector(query)))

    def title(self, query: str, limit: int) -> list[dict]:
        self.checked(query, limit)
        return self.rows(self.engine.search_title(query, limit))

    def lexical(self, query: str, limit: int) -> list[dict]:
        self.checked(query, limit)
        return self.rows(self.engine.search_lexical(query, limit))

    def semantic(self, query: str, limit: int) -> list[dict]:
        self.checked(query, limit)
        if not self.ai:
            raise ApiError("Semantic search is not enabled", 400)
        return self.rows(self.engine.search_semantic(self.vector(query), limit))

    def distance(self, query: str, limit: int) -> list[dict]:
        self.checked(query, limit)
        return self.rows(self.engine.search_distance(query, limit))

    def article(self, article_id: int) -> dict:
        return self.engine.article(article_id)

    def searches(self) -> dict[str, Callable[[str, int], list[dict]]]:
        return {"": self.search, "title": self.title, "lexical": self.lexical, "semantic": self.semantic, "distance": self.distance}
