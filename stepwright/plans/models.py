"""Model boundaries: what a stage asks of an embedder, a generator or a judge, and deterministic stand-ins.

A model is a picklable object; it is opened once in each task and called on batches. A failing batch is tried again
row by row, and a row that still fails gets an error instead of a result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def open(self) -> None: ...

    def encode(self, texts: list[str]) -> np.ndarray: ...


class AudioModel(Protocol):
    """A captioner or transcriber: bytes of audio files in, texts out."""

    def open(self) -> None: ...

    def listen(self, audio: list[bytes]) -> list[str]: ...


class AudioEmbedder(Protocol):
    def open(self) -> None: ...

    def encode_audio(self, audio: list[bytes]) -> np.ndarray: ...


class Generator(Protocol):
    def open(self) -> None: ...

    def answer(self, prompts: list[str]) -> list[str]: ...


@dataclass
class HashEmbedder:
    """Signed hashed words: a stand-in for a text encoder."""

    dim: int = 64

    def open(self) -> None:
        pass

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        return out


@dataclass
class TemplateGenerator:
    """Fills a template with the prompt's JSON fields."""

    template: str

    def open(self) -> None:
        pass

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.template.format(**json.loads(p)) for p in prompts]


@dataclass
class LengthJudge:
    """Scores 1 to 5 by the prompt's field n."""

    def open(self) -> None:
        pass

    def answer(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"score": 1 + json.loads(p)["n"] % 5}) for p in prompts]


def bisected(call, items: list, width: int) -> Iterator[tuple[object, str | None]]:
    """(result, error) of each item: in batches of `width`; a batch that fails is called item by item."""
    for lo in range(0, len(items), width):
        part = items[lo : lo + width]
        try:
            got = call(part)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} items")
            yield from ((g, None) for g in got)
        except Exception:  # noqa: BLE001  a model may raise anything
            for x in part:
                try:
                    yield call([x])[0], None
                except Exception as e:  # noqa: BLE001
                    yield None, f"{type(e).__name__}: {e}"[:500]


def _called(df: DataFrame, column: str, model, call, results: list[tuple[str, str, pa.DataType]], batch: int, finish=lambda x: x) -> DataFrame:
    """df without column, with the model's result for it and error."""
    place, names = df.columns.index(column), df.columns
    keep = [c for c in df.columns if c != column]
    (name, kind, arrow), *_ = results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for b in batches:
            got = list(bisected(call, b.column(place).to_pylist(), batch))
            columns = [b.column(k) for k, c in enumerate(names) if c != column]
            made = [None if v is None else finish(v) for v, _ in got]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow), pa.array([e for _, e in got], pa.string())], names=[*keep, name, "error"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kinds}, `{name}` {kind}, error string")


def _unit(truncate: int | None):
    def unit(v) -> list[float]:
        v = np.asarray(v[:truncate], np.float64)
        return (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32).tolist()

    return unit


def embedded(df: DataFrame, text: str, model: Embedder, batch: int = 64, truncate: int | None = None) -> DataFrame:
    """df without text, with vector (unit length, the first `truncate` values if given) and error."""
    call = lambda x: list(model.encode([t or "" for t in x]))
    return _called(df, text, model, call, [("vector", "array<float>", pa.list_(pa.float32()))], batch, _unit(truncate))


def embedded_audio(df: DataFrame, audio: str, model: AudioEmbedder, batch: int = 8, truncate: int | None = None) -> DataFrame:
    """df without audio (bytes of a file), with vector (unit length) and error; a null audio is an error of its own row."""
    call = lambda x: list(model.encode_audio(x))
    return _called(df, audio, model, call, [("vector", "array<float>", pa.list_(pa.float32()))], batch, _unit(truncate))


def heard(df: DataFrame, audio: str, model: AudioModel, name: str, batch: int = 4) -> DataFrame:
    """df without audio (bytes of a file), with the model's text (a caption, a transcript) under `name`, and error."""
    return _called(df, audio, model, lambda x: model.listen(x), [(name, "string", pa.string())], batch)


def generated(df: DataFrame, prompt: str, model: Generator, name: str, batch: int = 16) -> DataFrame:
    """df without prompt, with the model's answer under `name`, and error."""
    return _called(df, prompt, model, lambda x: model.answer(x), [(name, "string", pa.string())], batch)


def parameters_b(model_name: str) -> float | None:
    """Billions of parameters that a model's name states, the largest of several (all weights are loaded); None if none."""
    return max((float(x) for x in re.findall(r"(?<![a-z0-9])(\d+(?:\.\d+)?) *b(?![a-z])", model_name.lower())), default=None)


def backend(model_name: str, gpu_gb: list[float], gpu_names: tuple[str, ...] = (), parameters: float | None = None, allow_sglang: bool = False) -> dict:
    """Which backend serves a model on these GPUs, why, with which tensor parallel size and quantisation.

    16-bit weights must fit the smallest GPU with a quarter of room, or all together with a third; else newer GPUs take
    8-bit weights, and what is left is served in 4 bits.
    """
    out = {"backend": "transformers", "reason": "no_visible_cuda_device", "tensor_parallel_size": 1, "quantization": None, "kv_cache_dtype": "auto"}
    if not gpu_gb:
        return out
    size = parameters if parameters is not None else parameters_b(model_name)
    if size is None:
        return out | {"backend": "vllm", "reason": "cuda_available_model_size_unknown"}
    need, least, names = 2.0 * size, min(gpu_gb), " ".join(gpu_names).lower()
    if least >= 1.25 * need:
        return out | {"backend": "vllm", "reason": "bf16_fits_single_gpu"}
    if len(gpu_gb) > 1 and sum(gpu_gb) >= 1.35 * need:
        return out | {"backend": "vllm", "reason": "bf16_fits_tensor_parallel", "tensor_parallel_size": len(gpu_gb)}
    if any(n in names for n in ("b100", "b200", "h100", "h200")):
        return out | {"backend": "vllm", "reason": "hopper_or_newer_fp8_fallback", "quantization": "fp8", "kv_cache_dtype": "fp8", "tensor_parallel_size": min(len(gpu_gb), 2)}
    if allow_sglang and any(n in model_name.lower() for n in ("moe", "qwen")):
        return out | {"backend": "sglang_local", "reason": "sglang_enabled_for_qwen_or_moe"}
    small = "a100" in names or least <= 48
    return out | {"backend": "transformers_bnb", "reason": "single_or_low_memory_ampere_nf4_fallback" if small else "conservative_nf4_fallback", "quantization": "nf4"}
