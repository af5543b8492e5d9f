"""Video as a row per frame (video_id, frame_idx, width, height, pixels): numpy kernels on Arrow batches.

A kernel sees one frame and its index, so frames are worked on in parallel in any
order; what depends on time is a closed form of the index. Frames are rgb24 in
row order. An effect with a window leaves the other frames as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["video_id", "frame_idx", "width", "height", "pixels"]
FRAMES = "video_id long, frame_idx long, width int, height int, pixels binary"
Kernel = Callable[[np.ndarray, int, int], np.ndarray]
KERNELS: dict[str, Callable[..., Kernel]] = {}


def kernel(name: str):
    """Registers a function of an effect's parameters that gives a function of (frame, local index, window length)."""

    def put(build: Callable[..., Kernel]) -> Callable[..., Kernel]:
        if name in KERNELS:
            raise ValueError(f"effect {name!r} is there already")
        KERNELS[name] = build
        return build

    return put


SLICE_BYTES = 1 << 20  #: of frames that are worked on at a time, but for one frame alone


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most SLICE_BYTES of pixels, a larger frame by itself."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("pixels")), 0), np.int64))
    s = 0
    while s < len(batch):
        full = int(np.searchsorted(size, SLICE_BYTES + (size[s - 1] if s else 0), "right"))
        yield batch.slice(s, max(1, full - s))
        s = max(s + 1, full)


def _shown(batch: pa.RecordBatch, run: Kernel, start: int, stop: int) -> list[pa.Array]:
    """A batch's columns after a kernel on frames [start, stop)."""
    out, sizes = [], []
    for i, w, h, raw in zip(*(batch.column(c).to_pylist() for c in ("frame_idx", "width", "height", "pixels"))):
        if start <= i < stop:
            shown = run(np.frombuffer(raw, np.uint8).reshape(h, w, 3), i - start, stop - start)
            raw, h, w = np.ascontiguousarray(shown).tobytes(), shown.shape[0], shown.shape[1]
        out.append(raw)
        sizes.append((w, h))
    width, height = (pa.array([s[k] for s in sizes], pa.int32()) for k in range(2))
    return [batch.column("video_id"), batch.column("frame_idx"), width, height, pa.array(out, pa.binary())]


def apply(frames: DataFrame, effect: str, total: int, /, start: int = 0, stop: int | None = None, **params) -> DataFrame:
    """frames with an effect on frames [start, stop) of each video of `total` frames."""
    stop = total if stop is None else min(stop, total)
    run = KERNELS[effect](**params)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_shown(batch, run, start, stop), COLUMNS)

    return frames.select(*COLUMNS).mapInArrow(go, FRAMES)


def apply_each(frames: DataFrame, effects: dict[str, dict], total: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """frames once for each effect, named in `effect`: one pass over them, as `apply` for each."""
    stop = total if stop is None else min(stop, total)
    runs = {name: KERNELS[name](**params) for name, params in effects.items()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, run in runs.items():
                yield pa.RecordBatch.from_arrays([*_shown(batch, run, start, stop), pa.array([name] * len(batch), pa.string())], [*COLUMNS, "effect"])

    return frames.select(*COLUMNS).mapInArrow(go, f"{FRAMES}, effect string")


def _mean_columns(pixels: pa.Array) -> list[pa.Array]:
    m = [np.frombuffer(p, np.uint8).reshape(-1, 3).mean(axis=0) if p else np.zeros(3) for p in pixels.to_pylist()]
    return [pa.array([x[k] for x in m], pa.float64()) for k in range(3)]


MEANS = "video_id long, frame_idx long, red double, green double, blue double"
MEAN_COLUMNS = ["video_id", "frame_idx", "red", "green", "blue"]


def means(frames: DataFrame) -> DataFrame:
    """video_id, frame_idx, the mean of each colour and the effect, if frames name one."""
    more = ["effect"] if "effect" in frames.columns else []

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), *_mean_columns(batch.column("pixels")), *map(batch.column, more)], [*MEAN_COLUMNS, *more])

    return frames.mapInArrow(go, MEANS + "".join(f", {c} string" for c in more))


def means_of_each(frames: DataFrame, effects: dict[str, dict], total: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """`means` of `apply_each` in one pass: changed frames live in one Python worker, SLICE_BYTES of frames at a time, and never leave it."""
    stop = total if stop is None else min(stop, total)
    runs = {name: KERNELS[name](**params) for name, params in effects.items()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                for name, run in runs.items():
                    video, frame, _, _, pixels = _shown(batch, run, start, stop)
                    yield pa.RecordBatch.from_arrays([video, frame, *_mean_columns(pixels), pa.array([name] * len(batch), pa.string())], [*MEAN_COLUMNS, "effect"])

    return frames.select(*COLUMNS).mapInArrow(go, f"{MEANS}, effect string")


def remap(frames: DataFrame, index: DataFrame) -> DataFrame:
    """The frames that an index map (video_id, frame_idx, src_idx) shows: a join on the source frame."""
    source = frames.select("video_id", F.col("frame_idx").alias("src_idx"), "width", "height", "pixels")
    return index.join(source, ["video_id", "src_idx"]).select("video_id", "frame_idx", "width", "height", "pixels")


def crossfade(frames: DataFrame, lengths: DataFrame, overlap: int) -> DataFrame:
    """Each video's last `overlap` frames faded into the first of the next one. lengths: video_id, frame_count, next_id."""
    tail = frames.join(lengths, "video_id").withColumn("k", F.col("frame_idx") - (F.col("frame_count") - overlap)).filter("k >= 0 and next_id is not null")
    head = frames.filter(F.col("frame_idx") < overlap).select(F.col("video_id").alias("next_id"), F.col("frame_idx").alias("k"), F.col("pixels").alias("other"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in ("k", "pixels", "other"))):
                t = (k + 1) / (overlap + 1)
                out.append(np.rint(np.frombuffer(a, np.uint8) * (1 - t) + np.frombuffer(b, np.uint8) * t).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video_id", "frame_idx", "width", "height")), pa.array(out, pa.binary())], ["video_id", "frame_idx", "width", "height", "pixels"])

    return tail.join(head, ["next_id", "k"]).select("video_id", "frame_idx", "width", "height", "pixels", "other", F.col("k").cast("int").alias("k")).mapInArrow(go, FRAMES)


def hashes(frames: DataFrame, side: int = 8) -> DataFrame:
    """video_id, frame_idx, code: which of the cells of a side x side grid are brighter than their median."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, p in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels"))):
                cells = resized(np.frombuffer(p, np.uint8).reshape(h, w, 3), side, side).mean(axis=2)
                out.append(int.from_bytes(np.packbits(cells.ravel() > np.median(cells)).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("frame_idx"), pa.array(out, pa.int64())], ["video_id", "frame_idx", "code"])

    return frames.mapInArrow(go, "video_id long, frame_idx long, code long")


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resized(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = frame.shape[:2]
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, h), (width, w)))
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = frame.astype(np.float32)
    return _bytes((f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx) * (1 - fy) + (f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx) * fy)


def blurred(frame: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, borders reflected."""
    if sigma <= 0:
        return frame
    r = min(max(1, int(3 * sigma + 0.5)), min(frame.shape[:2]) - 1) if min(frame.shape[:2]) > 1 else 0
    if not r:
        return frame
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight /= weight.sum()
    out = frame.astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="reflect")
        n = out.shape[axis]
        out = sum(wt * np.take(padded, np.arange(k, k + n), axis=axis) for k, wt in enumerate(weight))
    return _bytes(out)


def shifted(frame: np.ndarray, dx: int, dy: int) -> np.ndarray:
    h, w = frame.shape[:2]
    mirror = lambda i, n: np.abs((i + n) % (2 * n) - n + (((i + n) % (2 * n)) < n)) % n if n else i
    return frame[mirror(np.arange(h) - dy, h)][:, mirror(np.arange(w) - dx, w)]


def ramp(i: int, n: int, mode: str) -> float:
    t = i / max(1, n - 1)
    return t if mode == "ascending" else 1 - t if mode == "descending" else 1.0


@kernel("fade")
def fade(mode: str = "in", curve: str = "linear", frames: int = 0) -> Kernel:
    shape = {"linear": lambda t: t, "sqrt": np.sqrt, "exponential": lambda t: t * t}[curve]

    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        length = max(1, min(frames or n, n))
        a = min(1.0, i / length) if mode in ("in", "in_out") else 1.0
        b = min(1.0, (n - 1 - i) / length) if mode in ("out", "in_out") else 1.0
        return _bytes(frame * shape(min(a, b)))

    return run


@kernel("flash")
def flash(color: tuple = (255, 255, 255), attack: int = 2, decay: int = 6, peak: float = 1.0) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        a = peak * (i + 1) / attack if i < attack else peak * max(0.0, 1 - (i - attack + 1) / decay)
        return _bytes(frame * (1 - a) + np.array(color) * a)

    return run


@kernel("color_adjust")
def color_adjust(brightness: float = 0.0, contrast: float = 1.0, saturation: float = 1.0, temperature: float = 0.0) -> Kernel:
    base = np.clip((np.arange(256) / 255 - 0.5) * contrast + 0.5 + brightness, 0, 1) * 255

    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        out = base[frame]
        gray = out @ np.array([0.299, 0.587, 0.114])
        out = gray[..., None] + (out - gray[..., None]) * saturation
        return _bytes(out + np.array([1, 0, -1]) * temperature * 30)

    return run


@kernel("vignette")
def vignette(strength: float = 0.5, radius: float = 1.0) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        h, w = frame.shape[:2]
        y, x = np.linspace(-1, 1, h)[:, None], np.linspace(-1, 1, w)[None]
        mask = 1 - strength * np.clip((np.sqrt(x * x + y * y) / np.sqrt(2) / radius) ** 2, 0, 1)
        return _bytes(frame * mask[..., None])

    return run


@kernel("blur_effect")
def blur_effect(sigma: float = 2.0, mode: str = "constant") -> Kernel:
    return lambda frame, i, n: blurred(frame, sigma * ramp(i, n, mode))


@kernel("sharpen")
def sharpen(amount: float = 1.0, sigma: float = 1.0) -> Kernel:
    return lambda frame, i, n: _bytes(frame * (1 + amount) - blurred(frame, sigma) * amount)


def _zoomed(frame: np.ndarray, factor: float) -> np.ndarray:
    h, w = frame.shape[:2]
    ch, cw = max(1, round(h / factor)), max(1, round(w / factor))
    y, x = (h - ch) // 2, (w - cw) // 2
    return resized(frame[y : y + ch, x : x + cw], w, h)


@kernel("zoom_effect")
def zoom_effect(factor: float = 1.5, mode: str = "in") -> Kernel:
    return lambda frame, i, n: _zoomed(frame, 1 + (factor - 1) * ramp(i, n, "ascending" if mode == "in" else "descending"))


@kernel("punch_in")
def punch_in(factor: float = 1.2, attack: int = 3, release: int = 8) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        t = 1 - (1 - (i + 1) / attack) ** 2 if i < attack else max(0.0, 1 - (i - attack) / release)
        return _zoomed(frame, 1 + (factor - 1) * t)

    return run


@kernel("ken_burns")
def ken_burns(start: tuple = (0, 0, 1, 1), end: tuple = (0.25, 0.25, 0.5, 0.5)) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        t = i / max(1, n - 1)
        t = 2 * t * t if t < 0.5 else 1 - (2 - 2 * t) ** 2 / 2
        h, w = frame.shape[:2]
        x, y, cw, ch = (a + (b - a) * t for a, b in zip(start, end))
        cw, ch = max(1, min(w, int(cw * w))), max(1, min(h, int(ch * h)))
        x, y = min(int(x * w), w - cw), min(int(y * h), h - ch)
        return resized(frame[y : y + ch, x : x + cw], w, h)

    return run


@kernel("shake")
def shake(amount: int = 3, mode: str = "rhythmic", period: int = 8) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        size = amount * (1 - i / n) if mode == "decay" else amount
        if mode == "random":
            dx, dy = np.random.default_rng(i).integers(-amount, amount + 1, 2)
        else:
            dx, dy = round(size * np.sin(2 * np.pi * i / period)), round(size * np.cos(2 * np.pi * i / period))
        return shifted(frame, int(dx), int(dy))

    return run


@kernel("chromatic_aberration")
def chromatic_aberration(shift: int = 2, direction: str = "horizontal") -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        dx, dy = (shift, 0) if direction == "horizontal" else (0, shift)
        return np.stack([shifted(frame[..., :1], dx, dy)[..., 0], frame[..., 1], shifted(frame[..., 2:], -dx, -dy)[..., 0]], axis=-1)

    return run


@kernel("glitch")
def glitch(slices: int = 4, amount: int = 8, seed: int = 0) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        rng, out, h = np.random.default_rng(seed + i), frame.copy(), len(frame)
        for _ in range(slices):
            y = int(rng.integers(0, h))
            end = min(h, y + 1 + int(rng.integers(0, max(1, h // slices))))
            out[y:end] = np.roll(out[y:end], int(rng.integers(-amount, amount + 1)), axis=1)
        return out

    return run


@kernel("film_grain")
def film_grain(strength: float = 10.0, seed: int = 0) -> Kernel:
    return lambda frame, i, n: _bytes(frame + np.random.default_rng(seed + i).normal(0, strength, frame.shape[:2])[..., None])


@kernel("pixelate")
def pixelate(size: int = 4) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        h, w = frame.shape[:2]
        small = np.add.reduceat(np.add.reduceat(frame.astype(np.float64), np.arange(0, h, size), 0), np.arange(0, w, size), 1)
        rows, cols = np.diff(np.append(np.arange(0, h, size), h)), np.diff(np.append(np.arange(0, w, size), w))
        mean = small / (rows[:, None] * cols[None])[..., None]
        return _bytes(np.repeat(np.repeat(mean, rows, 0), cols, 1))

    return run


@kernel("mirror_flip")
def mirror_flip(mode: str = "horizontal") -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        h, w = frame.shape[:2]
        if mode in ("horizontal", "vertical", "both"):
            return frame[:: -1 if mode != "horizontal" else 1, :: -1 if mode != "vertical" else 1]
        out = frame.copy()
        if mode == "left":
            out[:, w - w // 2 :] = frame[:, : w // 2][:, ::-1]
        elif mode == "right":
            out[:, : w // 2] = frame[:, w - w // 2 :][:, ::-1]
        elif mode == "top":
            out[h - h // 2 :] = frame[: h // 2][::-1]
        return out

    return run


@kernel("kaleidoscope")
def kaleidoscope(segments: int = 6) -> Kernel:
    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        h, w = frame.shape[:2]
        y, x = np.mgrid[0:h, 0:w]
        y, x = y - (h - 1) / 2, x - (w - 1) / 2
        wedge = 2 * np.pi / segments
        angle = np.abs((np.arctan2(y, x) % wedge) - wedge / 2)
        r = np.hypot(x, y)
        return frame[np.clip(np.rint(r * np.sin(angle) + (h - 1) / 2), 0, h - 1).astype(int), np.clip(np.rint(r * np.cos(angle) + (w - 1) / 2), 0, w - 1).astype(int)]

    return run


@kernel("crop")
def crop(x: int, y: int, width: int, height: int) -> Kernel:
    return lambda frame, i, n: frame[y : y + height, x : x + width]


@kernel("resize")
def resize(width: int, height: int) -> Kernel:
    return lambda frame, i, n: resized(frame, width, height)


@kernel("overlay")
def overlay(image: np.ndarray, x: int = 0, y: int = 0, fade_frames: int = 0) -> Kernel:
    """An RGBA image at (x, y), clipped to the frame, faded at both ends."""

    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        out = frame.astype(np.float32)
        h, w = frame.shape[:2]
        y0, x0, y1, x1 = max(0, y), max(0, x), min(h, y + image.shape[0]), min(w, x + image.shape[1])
        if y0 < y1 and x0 < x1:
            part = image[y0 - y : y1 - y, x0 - x : x1 - x]
            alpha = part[..., 3:] / 255 * (min(1.0, min(i, n - 1 - i) / fade_frames) if fade_frames else 1.0)
            out[y0:y1, x0:x1] = out[y0:y1, x0:x1] * (1 - alpha) + part[..., :3] * alpha
        return _bytes(out)

    return run


@kernel("draw_boxes")
def draw_boxes(boxes: list[tuple[float, float, float, float]], color: tuple = (76, 175, 80), width: int = 1) -> Kernel:
    """Outlines of normalised boxes."""

    def run(frame: np.ndarray, i: int, n: int) -> np.ndarray:
        out, (h, w) = frame.copy(), frame.shape[:2]
        for x, y, bw, bh in boxes:
            a, b = max(0, int(x * w)), max(0, int(y * h))
            c, d = min(w, int((x + bw) * w)), min(h, int((y + bh) * h))
            out[b : b + width, a:c] = out[max(b, d - width) : d, a:c] = color
            out[b:d, a : a + width] = out[b:d, max(a, c - width) : c] = color
        return out

    return run
