"""Neural models from ONNX files: shapes, the arrays that a call needs, and greedy generation with a cache.

Scoring of tables goes through ``score.onnx_scorer``; generation is a dialogue with one session and runs
where it is called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ModelShape:
    layers: int
    heads: int
    head_size: int = 64
    positions: int = 1024
    vocabulary: int = 50257

    @property
    def width(self) -> int:
        return self.heads * self.head_size

    def empty_cache(self, batch: int = 1) -> np.ndarray:
        """One cache input before the first token."""
        return np.zeros((batch, self.heads, 0, self.head_size), np.float32)


# Fixed values of the public models
GPT2 = ModelShape(layers=12, heads=12)
GPT2_LARGE = ModelShape(layers=36, heads=20)


def input_arrays(tokens: np.ndarray, past: int = 0) -> dict[str, np.ndarray]:
    """input_ids, position_ids and attention_mask of tokens (batch x length) after ``past`` tokens."""
    batch, n = tokens.shape
    return {
        "input_ids": tokens.astype(np.int64),
        "position_ids": np.broadcast_to(np.arange(past, past + n), (batch, n)).astype(np.int64),
        "attention_mask": np.ones((batch, past + n), np.int64),
    }


class CachedModel:
    """A session whose inputs with ``past`` in their name take the outputs with ``present`` of the call before,
    in the order of the model. Inputs that a model does not have are not fed."""

    def __init__(self, session, shape: ModelShape) -> None:
        self.session, self.shape = session, shape
        self.inputs = [x.name for x in session.get_inputs()]
        self.outputs = [x.name for x in session.get_outputs()]
        self.past = [n for n in self.inputs if "past" in n]
        self.present = [n for n in self.outputs if "present" in n]
        if len(self.past) != len(self.present):
            raise ValueError("the model has other numbers of cache inputs and outputs")
        self.reset()

    @staticmethod
    def from_file(path: str, shape: ModelShape) -> CachedModel:
        import onnxruntime

        return CachedModel(onnxruntime.InferenceSession(path), shape)

    def reset(self, batch: int = 1) -> None:
        self.seen = 0
        self.cache = [self.shape.empty_cache(batch) for _ in self.past]

    def step(self, tokens: np.ndarray) -> np.ndarray:
        """Logits (batch x length x vocabulary) of tokens after all that came before."""
        feed = {k: v for k, v in input_arrays(tokens, self.seen).items() if k in self.inputs}
        feed.update(zip(self.past, self.cache, strict=True))
        out = dict(zip(self.outputs, self.session.run(None, feed), strict=True))
        self.cache = [out[n] for n in self.present]
        self.seen += tokens.shape[1]
        return out["logits"]

    def generate(self, prompt: list[int], steps: int) -> list[int]:
        """``steps`` tokens after the prompt, each the likeliest, the smallest id of ties."""
        if not prompt:
            raise ValueError("the prompt is empty")
        if steps > 0 and not self.past:
            raise ValueError("generation needs a model with a cache")
        if len(prompt) + steps > self.shape.positions:
            raise ValueError("prompt and steps exceed the model's positions")
        self.reset()
        out, logits = [], self.step(np.array([prompt]))
        for k in range(steps):
            out.append(int(np.argmax(logits[0, -1])))
            if k + 1 < steps:
                logits = self.step(np.array([out[-1:]]))
        return out
