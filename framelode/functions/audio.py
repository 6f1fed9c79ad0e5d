"""Samples as arrays: levels, filters, correlation, downmix; picture arithmetic at the end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the resampling filter: taps, cutoff and input rate.
TAPS, CUTOFF, RATE = 63, 7600.0, 48000.0

# Fixed values of the perceptual quantiser (SMPTE ST 2084).
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875

HALF_POWER = math.sqrt(0.5)

#: Weights of each channel in the left and the right output, by channel count: L R C LFE Ls Rs Lb Rb.
DOWNMIX: dict[int, tuple[list[float], list[float]]] = {
    1: ([1.0], [1.0]),
    2: ([1.0, 0.0], [0.0, 1.0]),
    6: ([1.0, 0.0, HALF_POWER, 0.5, HALF_POWER, 0.0], [0.0, 1.0, HALF_POWER, 0.5, 0.0, HALF_POWER]),
    8: ([1.0, 0.0, HALF_POWER, 0.5, HALF_POWER, 0.0, HALF_POWER, 0.0], [0.0, 1.0, HALF_POWER, 0.5, 0.0, HALF_POWER, 0.0, HALF_POWER]),
}


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def peak(x: str) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms(x: str) -> Column:
    return F.sqrt(F.try_divide(_sum(F.transform(x, lambda v: v * v)), F.size(x)))


def to_pcm16(x: str) -> Column:
    """Rounded half away from zero; 32768 steps below zero, 32767 above."""
    held = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return F.transform(x, lambda v: F.round(F.when(v < 0, held(v) * 32768).otherwise(held(v) * 32767)).cast("long"))


def from_pcm(value: Column, bits: int) -> Column:
    return value / float(1 << (bits - 1))


def frames(x: Column, channels: int) -> Column:
    """Interleaved samples as one array per frame; a last partial frame is dropped."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / channels).cast("int") - 1), lambda i: F.slice(x, i * channels + 1, F.lit(channels)))


def mono(x: str) -> Column:
    return F.transform(frames(F.col(x), 2), lambda c: (c[0] + c[1]) / 2)


def downmix(frame: Column, channels: int) -> tuple[Column, Column]:
    """Left and right of one frame, limited to 1."""
    mixed = (sum((F.lit(w) * frame[i] for i, w in enumerate(side) if w), F.lit(0.0)) for side in DOWNMIX[channels])
    left, right = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m)) for m in mixed)
    return left, right


def ema(values: Column, alpha: float = 0.1) -> Column:
    """The first value, then a step of alpha towards each next one."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a + alpha * (x - a)))


def envelope(df: DataFrame, index: str, value: str, width: int) -> DataFrame:
    """Log energy of each full bin of `width` rows."""
    return df.groupBy(F.floor(F.col(index) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(value) * F.col(value)).alias("e")).filter(F.col("n") == width).select("bin", F.round(F.log1p(F.sqrt("e") * 1000), 6).alias("energy"))


def hops(at: Column, size: int, hop: int) -> Column:
    """The numbers of the windows [hop k, hop k + size) that hold a place."""
    return F.sequence(F.greatest(F.lit(0), F.ceil((at - size + 1) / hop)).cast("long"), F.floor(at / hop).cast("long"))


def low_pass(taps: int = TAPS, cutoff: float = CUTOFF, rate: float = RATE) -> list[float]:
    """A sinc under a Hann window, of unit gain at rest."""
    middle, share = (taps - 1) / 2, cutoff / rate
    raw = []
    for n in range(taps):
        t = n - middle
        sinc = 2 * share if t == 0 else math.sin(2 * math.pi * share * t) / (math.pi * t)
        raw.append(sinc * (0.5 - 0.5 * math.cos(2 * math.pi * n / (taps - 1))))
    total = sum(raw)
    return [x / total for x in raw]


def fir(x: str, keep_every: int) -> Column:
    """The low pass over silence and then x; outputs 0, keep_every, ... limited to 1."""
    taps = F.array(*map(F.lit, low_pass()))
    at = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / keep_every).cast("int")), lambda i: i * keep_every)
    one = lambda i: _sum(F.transform(F.sequence(F.lit(0), F.least(i, F.lit(TAPS - 1))), lambda k: taps[k] * F.col(x)[i - k]))
    return F.transform(at, lambda i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), one(i))))


def compare(x: str, y: str) -> tuple[Column, Column]:
    """Root of the ratio of energies; correlation without centring. Null for silence."""
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda p, q: p * q))
    return F.sqrt(F.try_divide(dot(x, x), dot(y, y))), F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def _pearson(x: Column, y: Column) -> Column:
    n = F.size(x)
    mean = lambda a: _sum(a) / n
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda p, q: p * q)) / n
    spread = lambda a: dot(a, a) - mean(a) * mean(a)
    return F.coalesce(F.try_divide(dot(x, y) - mean(x) * mean(y), F.sqrt(F.greatest(spread(x) * spread(y), F.lit(0.0)))), F.lit(-1.0))


def best_lag(x: str, y: str, begin: int, count: int, most: int) -> Column:
    """(corr, lag) of the highest centred correlation of x[begin:begin+count] with y shifted; the lowest lag of equals."""
    own = F.slice(x, begin + 1, count)
    found = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda k: F.struct(_pearson(own, F.slice(F.col(y), k + begin + 1, F.lit(count))).alias("corr"), k.alias("lag")))
    better = lambda a, b: F.when(F.round(b["corr"], 9) > F.round(a["corr"], 9), b).otherwise(a)
    return F.aggregate(found, F.struct(F.lit(-2.0).alias("corr"), F.lit(0).alias("lag")), better)


def pq_nits(code: Column) -> Column:
    """Light in nits of a code value from 0 to 1."""
    p = F.pow(code, F.lit(1 / PQ_M2))
    return 10000 * F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (F.lit(PQ_C2) - PQ_C3 * p), F.lit(1 / PQ_M1))


def letterbox(width: Column, height: Column, aspect: Column, to_width: int, to_height: int) -> list[Column]:
    """out_w, out_h, x, y of a picture fitted and centred, its samples `aspect` wide; 1 pixel at least, the target at most.

    Without a size the whole target; an aspect that is none, or out of 0.01 to 100, counts as 1.
    """
    sane = F.when(aspect.between(0.01, 100.0) & ~F.isnan(aspect.cast("double")), aspect.cast("double")).otherwise(1.0)
    shape = width * sane / height
    wide = shape > to_width / to_height
    fit = lambda v, most: F.greatest(F.lit(1), F.least(F.round(v).cast("long"), F.lit(most)))
    out_w = F.when(wide, to_width).otherwise(fit(to_height * shape, to_width))
    out_h = F.when(wide, fit(to_width / shape, to_height)).otherwise(to_height)
    real = (width > 0) & (height > 0) & F.lit(to_width > 0 and to_height > 0)
    out_w, out_h = (F.when(real, v).otherwise(most).cast("long") for v, most in ((out_w, to_width), (out_h, to_height)))
    return [out_w.alias("out_w"), out_h.alias("out_h"), F.floor((to_width - out_w) / 2).alias("x"), F.floor((to_height - out_h) / 2).alias("y")]


# BT.2020 to BT.709, luminance weights, white and peak in nits.
TO_709 = [(1.660496, -0.587656, -0.072840), (-0.124547, 1.132895, -0.008348), (-0.018154, -0.100597, 1.118751)]
LUMA_709 = (0.2126, 0.7152, 0.0722)
WHITE_NITS, PEAK_NITS = 203.0, 1000.0


def tone_map(rgb: Column) -> Column:
    """PQ-coded BT.2020 red, green and blue as an array, to gamma-2.2 coded BT.709: light, matrix, Reinhard map of the luminance."""
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    dot = lambda weights, v: sum(w * F.get(v, F.lit(i)) for i, w in enumerate(weights))
    light = F.transform(rgb, lambda c: pq_nits(clamp(c)))
    linear = lambda v: F.array(*[F.greatest(dot(row, v), F.lit(0.0)) / WHITE_NITS for row in TO_709])
    white = PEAK_NITS / WHITE_NITS

    def mapped(v: Column) -> Column:
        luma = dot(LUMA_709, v)
        scale = F.when(luma > 1e-6, (1 + luma / (white * white)) / (1 + luma)).otherwise(0.0)
        return F.transform(v, lambda c: F.pow(clamp(c * scale), F.lit(1 / 2.2)))

    return F.get(F.transform(F.transform(F.array(light), linear), mapped), F.lit(0))


def gain_of(value: Column) -> Column:
    """AC-3 dynamic range gain of a byte: a three-bit exponent with sign and five bits of fraction."""
    exponent = F.shiftright(value, 5).bitwiseAND(7)
    return (32 + value.bitwiseAND(31)) / 64 * F.pow(F.lit(2.0), F.when(exponent >= 4, exponent - 8).otherwise(exponent) + 1)


# AC-3 bit rates in kbit/s and words of a frame at 44.1 kHz.
AC3_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_WORDS_44100 = [69, 87, 104, 121, 139, 174, 208, 243, 278, 348, 417, 487, 557, 696, 835, 975, 1114, 1253, 1393]


def ac3_frame_words(rate: Column, code: Column) -> Column:
    """16-bit words of an AC-3 frame by sampling-rate code (0: 48, 1: 44.1, 2: 32 kHz) and frame-size code; 0 where there is none."""
    at = lambda table: F.get(F.lit(table), F.shiftright(code, 1))
    words = F.when(rate == 0, at(AC3_RATES) * 2).when(rate == 1, at(AC3_WORDS_44100) + code.bitwiseAND(1)).when(rate == 2, at(AC3_RATES) * 3)
    return F.coalesce(F.when(code.between(0, 37), words), F.lit(0)).cast("long")


def dequantize(value: Column, factor: Column) -> Column:
    """AAC: the value to the power of 4/3, sign kept, times two to a quarter of what the scale factor is over 100."""
    return F.signum(value.cast("double")) * F.pow(F.abs(value).cast("double"), F.lit(4 / 3)) * F.pow(F.lit(2.0), (factor - 100) * 0.25)


def noise(seed: int, count: int) -> Column:
    """The first values of a 32-bit xorshift sequence (13, 17, 5), from -1 to 1."""
    low = 0xFFFFFFFF

    def step(acc: Column, _: Column) -> Column:
        let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
        state = let(acc["s"].bitwiseXOR(F.shiftleft(acc["s"], 13).bitwiseAND(low)), lambda a: let(a.bitwiseXOR(F.shiftright(a, 17)), lambda b: b.bitwiseXOR(F.shiftleft(b, 5).bitwiseAND(low))))
        return let(state, lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(F.when(s >= 1 << 31, s - (1 << 32)).otherwise(s) / ((1 << 31) - 1))).alias("out")))

    start = F.struct(F.lit(seed).cast("long").alias("s"), F.expr("cast(array() as array<double>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step, lambda acc: acc["out"])


# Fixed value: the ceiling of the downmix limiter.
LIMIT = 0.98


def limiter_gains(peaks: Column, rate: int, frame: int = 1024) -> Column:
    """Gain of each frame of a track by its peak: down at once, up again slowly."""
    release = 1 - math.exp(-frame / rate)

    def step(acc: Column, peak: Column) -> Column:
        target, last = F.when(peak > LIMIT, LIMIT / peak).otherwise(1.0), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1.0))
        return F.concat(acc, F.array(F.when(target < last, target).otherwise(last + (target - last) * release)))

    return F.aggregate(peaks, F.expr("cast(array() as array<double>)"), step)


def bessel_i0(x: float) -> float:
    """The series of the modified Bessel function of order 0, under 40 terms, up to a relative 1e-15."""
    total = term = 1.0
    for k in range(1, 40):
        term *= x * x / 4 / (k * k)
        total += term
        if term < total * 1e-15:
            break
    return total


def sine_window(length: int) -> list[float]:
    return [math.sin(math.pi * (i + 0.5) / (2 * length)) for i in range(length)]


def kbd_window(length: int, alpha: float) -> list[float]:
    """Kaiser-Bessel derived: roots of the running share of a Kaiser window's sum."""
    kaiser = [bessel_i0(math.pi * alpha * math.sqrt(max(0.0, 1 - (2 * i / (length - 1) - 1) ** 2))) for i in range(length)]
    return np.sqrt(np.cumsum(kaiser) / sum(kaiser)).tolist()


def imdct(spectrum: np.ndarray) -> np.ndarray:
    """N coefficients to 2N samples: cos(pi / N (n + 1/2 + N/2)(k + 1/2)), summed by one complex transform, over N."""
    n = len(spectrum)
    turned = spectrum * np.exp(1j * np.pi * (n + 1) / (2 * n) * (np.arange(n) * 1.0))
    wave = np.fft.ifft(turned, 2 * n) * 2 * n
    return (wave * np.exp(1j * np.pi / (2 * n) * (np.arange(2 * n) + (n + 1) / 2))).real / n


def overlap_add(blocks: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Windowed blocks of 2N samples to N samples each: the first half of one is added to the second half of the one before."""
    n = blocks.shape[1] // 2
    shaped = blocks * np.concatenate([window, window[::-1]])
    return shaped[:, :n] + np.concatenate([np.zeros((1, n)), shaped[:-1, n:]])
