"""Settings: defaults, a YAML file's values over them, and the root from the environment over both."""

from __future__ import annotations

import copy
import os
from pathlib import Path

#: The shipped settings.
DEFAULTS = {
    "document_processing": {"doc_root": "~/Documents", "chunk_size": 800, "chunk_overlap": 100, "max_file_size_mb": 100},
    "embedding": {"model": "hash-64", "batch_size": 32},
    "search": {"mode": "hybrid", "filter_mode": "vector_only", "vector_top_n": 50, "bm25_top_n": 50, "rrf_k": 60, "rerank_top_n": 20},
    "reranker": {"enable": False, "model": "BAAI/bge-reranker-v2-m3", "batch_size": 16},
    "excluded_patterns": [r"\.DS_Store", "__pycache__", r"\.git", r"~\$", r"Thumbs\.db", r"desktop\.ini"],
    "ocr": {"enabled": False, "languages": ["eng", "kor"], "dpi": 300, "max_pages_per_pdf": 50, "timeout_per_page": 10},
    "contextual": {"enable": True},
}


def merged(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | None = None, root_variable: str = "MARLSTONE_ROOT") -> dict:
    """The settings; without a file (or a YAML parser) the defaults. Relative roots stand from the file's folder."""
    values = copy.deepcopy(DEFAULTS)
    if path and Path(path).exists():
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading a settings file needs PyYAML") from e
        values = merged(values, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    root = os.path.expanduser(os.environ.get(root_variable) or values["document_processing"]["doc_root"])
    if not os.path.isabs(root):
        root = os.path.join(os.path.dirname(os.path.abspath(path)) if path else os.getcwd(), root)
    values["document_processing"]["doc_root"] = root
    return values
