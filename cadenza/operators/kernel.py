"""The block transform on stacks of frames: chunk in, two halves of output out. Frames are independent rows."""

from __future__ import annotations

import numpy as np

from cadenza.functions.lpc import extrapolate, extrapolate_back
from cadenza.plans.config import Config

#: Up to this chunk size a stack of frames is multiplied by the transform's matrix instead of being transformed.
MATRIX_CHUNK = 64


def transform(frames: np.ndarray, config: Config) -> np.ndarray:
    """Each row (chunk_in samples) as 2 * chunk_out output samples: placed in a zero window, tapered, remapped, scaled."""
    g = config.geometry
    if g.chunk_in <= MATRIX_CHUNK and len(frames) > g.chunk_in:
        return frames @ matrix(config)
    window = np.zeros((len(frames), g.fft_in), dtype=config.numpy_dtype)
    window[:, g.offset_in : g.offset_in + g.chunk_in] = frames
    spectrum = np.fft.rfft(window, axis=1)
    if config.rotation is not None:
        spectrum[:, : g.cutoff_bins] *= config.rotation.astype(spectrum.dtype)
    bins = min(g.chunk_in, g.chunk_out) + 1
    out = np.zeros((len(frames), g.chunk_out + 1), dtype=spectrum.dtype)
    out[:, :bins] = spectrum[:, :bins] * config.taper_curve[:bins]
    out[:, 0].imag = 0
    out[:, -1].imag = 0
    return np.fft.irfft(out, n=g.fft_out, axis=1) * config.numpy_dtype(g.scale)


_matrices: dict[Config, np.ndarray] = {}


def matrix(config: Config) -> np.ndarray:
    """The transform as a matrix (chunk_in x 2 chunk_out), kept per process."""
    if config not in _matrices:
        _matrices[config] = transform(np.eye(config.geometry.chunk_in, dtype=config.numpy_dtype), config)
    return _matrices[config]


def start_context(first_chunk: np.ndarray, pre: np.ndarray | None, config: Config) -> np.ndarray:
    """The samples before the first: the end of ``pre``, and what it lacks predicted backwards from the first chunk alone."""
    n = config.geometry.offset_in
    known = pre[len(pre) - min(len(pre), n) :] if pre is not None and len(pre) else first_chunk[:0]
    return np.concatenate((extrapolate_back(first_chunk, n - len(known)), known))


def tail(base: np.ndarray, post: np.ndarray | None, n: int) -> np.ndarray:
    """The n samples after ``base``: the head of ``post``, and what it lacks predicted from base and that head."""
    known = post[:n] if post is not None else base[:0]
    return np.concatenate((known, extrapolate(np.concatenate((base, known)), n - len(known))))


def frames_of(x: np.ndarray, pre: np.ndarray | None, post: np.ndarray | None, config: Config) -> np.ndarray:
    """All frames of a signal, from the one before its start to the one after its end."""
    c = config.geometry.chunk_in
    full, rest = divmod(len(x), c)
    start = np.concatenate((np.zeros(c - config.geometry.offset_in, dtype=x.dtype), start_context(x[:c], pre, config)))
    # A short last frame reaches into one more block, which a frame of silence makes room for.
    return np.vstack((start, x[: full * c].reshape(full, c), last_frame(x[max(0, full - 1) * c :], full, rest, post, config), *[np.zeros(c, dtype=x.dtype)] * bool(rest)))


def last_frame(end: np.ndarray, full: int, rest: int, post: np.ndarray | None, config: Config) -> np.ndarray:
    """The frame that closes a signal: a short chunk filled up, or after a whole number of chunks half a chunk of prediction.

    ``end`` holds the last whole chunk, if there is one, and the ``rest`` samples after it.
    """
    c, half = config.geometry.chunk_in, config.geometry.offset_in
    if rest:
        base = end[-c:] if full else np.concatenate((np.zeros(c - rest, dtype=end.dtype), end))
        return np.concatenate((end[len(end) - rest :], tail(base, post, c)[: c - rest]))
    return np.concatenate((tail(end[-c:], post, half), np.zeros(c - half, dtype=end.dtype)))


def overlap_add(halves: np.ndarray) -> np.ndarray:
    """Blocks 0 on: each the first half of its frame and the second half of the frame before it."""
    o = halves.shape[1] // 2
    return (halves[1:, :o] + halves[:-1, o:]).ravel()


def resample_signal(x: np.ndarray, config: Config, pre: np.ndarray | None = None, post: np.ndarray | None = None) -> np.ndarray:
    """A whole signal in, exactly config.output_size(len(x)) samples out."""
    x = np.asarray(x, dtype=config.numpy_dtype)
    if config.passthrough or not len(x):
        return x.copy()
    context = [None if p is None else np.asarray(p, dtype=config.numpy_dtype) for p in (pre, post)]
    frames = frames_of(x, *context, config)
    g, step = config.geometry, max(1, (4 << 20) // config.geometry.fft_out)
    if len(frames) <= step:
        out = overlap_add(transform(frames, config))
    else:  # bounded work space: neighbouring stacks share a frame
        out = np.concatenate([overlap_add(transform(frames[k : k + step + 1], config)) for k in range(0, len(frames) - 1, step)])
    return out[g.offset_out : g.offset_out + config.output_size(len(x))]


class Stream:
    """Chunk-by-chunk resampling of one channel with bounded state: what a stream carries from batch to batch.

    ``push`` takes any number of samples and returns what is ready; ``finish`` returns the rest. State is the samples
    of an incomplete chunk, the chunk before it, the overlap, and counters.
    """

    def __init__(self, config: Config, pre: np.ndarray | None = None):
        self.config, self.pre, self.post = config, pre, None
        kind = config.numpy_dtype
        self.held, self.before, self.overlap = np.zeros(0, dtype=kind), np.zeros(0, dtype=kind), None
        self.n_in = self.n_out = self.chunks = 0
        self.finished = False

    def push(self, samples: np.ndarray) -> np.ndarray:
        from cadenza.plans.config import ResampleError

        if self.finished:
            raise ResampleError("AlreadyFinalized", "the stream has ended")
        samples = np.asarray(samples, dtype=self.config.numpy_dtype)
        self.n_in += len(samples)
        if self.config.passthrough:
            self.n_out += len(samples)
            return samples
        data = np.concatenate((self.held, samples))
        c = self.config.geometry.chunk_in
        n = len(data) // c
        self.held = data[n * c :]
        if not n:
            return data[:0]
        chunks = data[: n * c].reshape(n, c)
        frames = chunks if self.overlap is not None else np.vstack((self._start(chunks[0]), chunks))
        self.before = chunks[-1].copy()
        self.chunks += n
        return self._emit(frames)

    def finish(self) -> np.ndarray:
        from cadenza.plans.config import ResampleError

        if self.finished:
            raise ResampleError("AlreadyFinalized", "the stream has ended")
        self.finished = True
        if self.config.passthrough or not self.n_in:
            return self.held
        frames = last_frame(np.concatenate((self.before, self.held)), int(self.chunks > 0), len(self.held), self.post, self.config)[None, :]
        if self.overlap is None:
            frames = np.vstack((self._start(self.held), frames))
        if len(self.held):
            frames = np.vstack((frames, np.zeros_like(frames[:1])))
        out = self._emit(frames)
        return out[: max(0, len(out) - (self.n_out - self.config.output_size(self.n_in)))]

    def follow(self, head: np.ndarray) -> None:
        """The head of the track that follows, from which the end's context is taken in place of a prediction."""
        from cadenza.plans.config import ResampleError

        if self.finished:
            raise ResampleError("AlreadyFinalized", "the stream has ended")
        self.post = np.asarray(head, dtype=self.config.numpy_dtype)

    def counters(self) -> dict[str, int | bool]:
        """Where the stream stands: samples taken and given, whole chunks, samples held, and its two states."""
        return {"n_in": self.n_in, "n_out": self.n_out, "chunks": self.chunks, "held": len(self.held), "primed": self.primed, "finished": self.finished}

    def reset(self) -> None:
        """Back to the start, with the same configuration and without context."""
        self.__init__(self.config)

    def _start(self, first: np.ndarray) -> np.ndarray:
        g = self.config.geometry
        return np.concatenate((np.zeros(g.chunk_in - g.offset_in, dtype=first.dtype), start_context(first, self.pre, self.config)))

    def _emit(self, frames: np.ndarray) -> np.ndarray:
        g = self.config.geometry
        halves = transform(frames, self.config)
        first = self.overlap is None
        if not first:
            halves = np.vstack((np.concatenate((np.zeros(g.chunk_out, dtype=halves.dtype), self.overlap)), halves))
        self.overlap = halves[-1, g.chunk_out :].copy()
        out = overlap_add(halves)
        out = out[g.offset_out :] if first else out
        self.n_out += len(out)
        return out

    @property
    def primed(self) -> bool:
        """Whether enough chunks have passed for output to flow without gaps."""
        return self.chunks >= 2 or self.finished
