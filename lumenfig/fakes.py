"""Deterministic stand-ins for models and formats, for tests and examples."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from lumenfig.operators.images import thinned


class HashEmbedder:
    """Unit vectors from hashed words; the same text gives the same vector."""

    def __init__(self, dim: int = 64, fail_on: str | None = None) -> None:
        self.dim, self.fail_on = dim, fail_on

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            if self.fail_on and self.fail_on in t:
                raise ValueError("cannot embed")
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[h[0] % self.dim] += 1 if h[1] % 2 else -1
            v[0] += 1e-3
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class Script:
    """A model that answers by rules: the first whose key occurs in the prompt; an exception is raised."""

    def __init__(self, rules: list[tuple[str, str | Exception]], other: str = "") -> None:
        self.rules, self.other, self.asked = rules, other, 0

    def complete(self, prompt: str, image: bytes | None) -> str:
        self.asked += 1
        for key, answer in self.rules:
            if key in prompt:
                if isinstance(answer, Exception):
                    raise answer
                return answer
        return self.other


class RawGrey:
    """Grey images as two 16-bit sizes (height, width) and their bytes."""

    def grey(self, content: bytes) -> np.ndarray:
        h, w = np.frombuffer(content[:4], np.uint16)
        return np.frombuffer(content[4:], np.uint8).reshape(int(h), int(w))

    def pack(self, grey: np.ndarray) -> bytes:
        return np.array(grey.shape, np.uint16).tobytes() + np.ascontiguousarray(grey, np.uint8).tobytes()

    def fit(self, content: bytes, widest: int) -> bytes:
        return self.pack(thinned(self.grey(content), widest))

    def crop(self, content: bytes, box: tuple[int, int, int, int]) -> bytes:
        x0, y0, x1, y1 = box
        return self.pack(self.grey(content)[y0:y1, x0:x1])


class ThinGrey(RawGrey):
    """The same, compressed; of equal rows in a run only the first is kept."""

    def grey(self, content: bytes) -> np.ndarray:
        raw = zlib.decompress(content)
        h, w = (int(v) for v in np.frombuffer(raw[:4], np.uint16))
        at = 4 + (h + 7) // 8
        new = np.unpackbits(np.frombuffer(raw[4:at], np.uint8), count=h).astype(bool)
        return np.frombuffer(raw[at:], np.uint8).reshape(int(new.sum()), w)[np.cumsum(new) - 1]

    def pack(self, grey: np.ndarray) -> bytes:
        grey = np.ascontiguousarray(grey, np.uint8)
        new = np.ones(len(grey), bool)
        new[1:] = (grey[1:] != grey[:-1]).any(1)
        return zlib.compress(np.array(grey.shape, np.uint16).tobytes() + np.packbits(new).tobytes() + grey[new].tobytes(), 1)
