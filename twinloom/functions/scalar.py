"""Scalar functions of the engine as Spark expressions (names, durations, quality, hashes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

# Bits per pixel of a clean copy, and codec efficiency against H.264.
TARGET_BPP = 0.04
CODEC_EFFICIENCY = {
    "av1": 2.0, "av01": 2.0, "hevc": 1.7, "h265": 1.7, "hev1": 1.7, "hvc1": 1.7, "vp9": 1.6, "vp09": 1.6, "h264": 1.0, "avc": 1.0, "avc1": 1.0,
    "vp8": 0.9, "mpeg4": 0.7, "msmpeg4v3": 0.7, "xvid": 0.7, "divx": 0.7, "vc1": 0.7, "wmv3": 0.7, "mpeg2video": 0.5, "mpeg2": 0.5, "mpeg1video": 0.4,
}
# Words of release names that are no part of a title.
RELEASE_TAGS = (
    "2160p", "1080p", "720p", "480p", "4k", "8k", "x264", "x265", r"h\.?264", r"h\.?265", "hevc", "av1", "vp9", "web-?dl", "webrip", "web",
    "bluray", "blu-ray", "bdrip", "brrip", "hdrip", "dvdrip", "dvd", "hdtv", "xvid", "divx", r"aac\d?", "ac3", "eac3", "dts(?:-hd)?", "truehd",
    "atmos", "hdr10?", r"dolby(?:\x20)?vision", "dv", "remux", "proper", "repack", "extended", "uncut", "unrated", "multi", "dual",
    "sub(?:s|titulado)?", "castellano", "latino", "esp", "eng",
)
# Codes that say a language is not known; ISO 639-1 to 639-2/B.
UNKNOWN_LANGUAGES = ("", "und", "unk", "unknown", "mis", "mul", "zxx")
ISO3 = {"es": "spa", "en": "eng", "fr": "fre", "de": "ger", "it": "ita", "pt": "por", "ja": "jpn", "ko": "kor", "zh": "chi", "ru": "rus"}
# How strong a verdict is.
VERDICT_RANK = {"CERTAIN": 5, "VERY_HIGH": 4, "HIGH": 3, "NAME_COPY": 2, "PROBABLE": 2, "DIFFERENT_EDITION": 1, "DIFFERENT": 0}
SAME_LABELS = ("same", "1", "true", "yes", "y", "dup", "duplicate", "match", "si", "igual")


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


# --- hashes -----------------------------------------------------------------


def sampled_hash(content: Column, size: Column, chunk: int) -> Column:
    """Digest of the head, and for contents longer than two chunks also of a chunk at the middle and the last one."""
    head = F.substring(content, 1, chunk)
    middle = content.substr((F.floor(size / 2) + 1).cast("int"), F.lit(chunk))
    last = content.substr((size - chunk + 1).cast("int"), F.lit(chunk))
    return F.md5(F.when(size > 2 * chunk, F.concat(head, middle, last)).otherwise(head))


def path_digest(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 16)


def pair_digest(a: Column, b: Column) -> Column:
    """Digest of an unordered pair."""
    x, y = a.cast("string"), b.cast("string")
    return F.sha2(F.concat_ws("\x1f", F.least(x, y), F.greatest(x, y)), 256)


# --- names and paths --------------------------------------------------------


def base_stem(stem: Column) -> Column:
    """The stem without trailing (N) markers of one to three digits."""
    return F.rtrim(F.regexp_replace(stem, r"(\s*\(\d{1,3}\)\s*)+$", ""))


def canonical_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no '.' parts, none at the end."""
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\./)+|/{2,}", "/")
    return F.when(out == "/", out).otherwise(F.regexp_replace(out, r"/\.?$", ""))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def name_key(path: Column) -> Column:
    """Folder, stem without copy markers and extension, lower-cased: equal for copies that differ in (N) only."""
    return F.struct(F.lower(directory(path)).alias("dir"), F.lower(F.trim(base_stem(stem(path)))).alias("stem"), F.lower(extension(path)).alias("ext"))


def clean_title(path: Column) -> Column:
    """A readable title: no extension, separators, brackets, release tags or group suffix."""
    out = F.regexp_replace(stem(path), r"[._]", " ")
    out = F.regexp_replace(out, r"[\[\](){}]", " ")
    out = F.regexp_replace(out, rf"(?i)\b({'|'.join(RELEASE_TAGS)})\b", " ")
    out = F.regexp_replace(out, r"-\s*[A-Za-z0-9]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ \-·]+|[ \-·]+$", "")


def volume_anchor(path: Column) -> Column:
    """Drive, network share or first folder of a path; '' for degenerate ones."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    drive, share = F.regexp_extract(p, r"^([A-Za-z]:)/", 1), F.regexp_extract(p, r"^(//[^/]+/[^/]+)", 1)
    return F.when(drive != "", drive).when(share != "", share).otherwise(F.regexp_extract(p, r"^(/[^/]+)/", 1))


def under_root(path: Column, root: str) -> Column:
    """Below root, with a separator at the border, whatever the case."""
    return F.lower(path).startswith(root.rstrip("/").lower() + "/")


def genre_of(path: Column, known: list[str]) -> Column:
    """The last folder of a path that names a known genre, else ''."""
    parts = F.filter(F.split(F.lower(directory(path)), "/"), lambda x: x.isin(known))
    return F.coalesce(F.when(F.size(parts) > 0, F.element_at(parts, -1)), F.lit(""))


# --- text of numbers --------------------------------------------------------


def duration_text(seconds: Column) -> Column:
    """H:MM:SS, from a day on Nd HH:MM:SS."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    d, h, m, x = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(d > 0, F.concat(d.cast("string"), F.lit("d "), two(h), F.lit(":"), two(m), F.lit(":"), two(x))).otherwise(F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(x)))


def clock_seconds(clock: Column) -> Column:
    """Seconds of a colon-separated time, each part sixty times the next; 0 if it can't be read."""
    parts = F.transform(F.split(F.trim(clock), ":"), lambda x: F.trim(x).try_cast("long"))
    return F.when(F.exists(parts, lambda x: x.isNull()), F.lit(0).cast("long")).otherwise(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x))


# Characters that frame an error's lines, and what is said if there are none.
BOX = "│┌┐└┘─╭╮╰╯├┤┬┴┼ \t"
NO_OUTPUT = "the process exited without output"


def error_summary(lines: Column) -> Column:
    """The last line that names an error at its start; else the last that mentions one; else the last that is not blank."""
    clean = F.transform(lines, lambda x: F.btrim(x, F.lit(BOX)))
    named = F.filter(clean, lambda x: x.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Interrupt|Exit)\b"))
    hinted = F.filter(clean, lambda x: x.rlike("Error|Exception|Traceback"))
    filled = F.filter(clean, lambda x: x != "")
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    name, rest = F.regexp_extract(last(named), r"^([\w.]*(?:Error|Exception|Interrupt|Exit))\b", 1), F.regexp_extract(last(named), r"^[\w.]*(?:Error|Exception|Interrupt|Exit)\b\s*:?\s*(.*)$", 1)
    best = F.when(last(named).isNull(), F.lit(None)).when(rest == "", name).otherwise(F.concat(name, F.lit(": "), rest))
    return F.coalesce(best, last(hinted), last(filled), F.lit(NO_OUTPUT))


def problem_category(error: Column) -> Column:
    return F.when(F.coalesce(F.lower(error), F.lit("")).rlike("timeout|timed out"), "reindex").otherwise("corrupt")


# --- probe ------------------------------------------------------------------

_STREAM = "struct<index:string,codec_name:string,codec_type:string,width:string,height:string,bit_rate:string,duration:string,channels:string,tags:map<string,string>>"
_PROBE_JSON = f"struct<streams:array<{_STREAM}>,format:struct<duration:string,bit_rate:string>>"


def parse_probe(body: Column) -> Column:
    """Probe output in JSON as the probe struct: duration from the container first, bit rate from the video stream first."""
    found = F.from_json(body, _PROBE_JSON)
    streams = F.coalesce(found["streams"], F.array().cast(f"array<{_STREAM}>"))
    video = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(1))
    number = lambda c: F.floor(c.try_cast("double")).try_cast("long")

    def track(s: Column) -> Column:
        raw = F.lower(F.trim(F.coalesce(F.try_element_at(s["tags"], F.lit("language")), F.try_element_at(s["tags"], F.lit("LANGUAGE")))))
        return F.struct(F.coalesce(number(s["index"]).cast("int"), F.lit(0)).alias("index"), F.when(~raw.isin(*UNKNOWN_LANGUAGES), raw).alias("lang_tag"), s["codec_name"].alias("codec"), number(s["channels"]).cast("int").alias("channels"))

    rate = F.coalesce(number(video["bit_rate"]), number(found["format"]["bit_rate"]))
    return F.struct(
        F.coalesce(found["format"]["duration"].try_cast("double"), video["duration"].try_cast("double"), F.lit(0.0)).alias("duration_s"),
        F.coalesce(number(video["width"]).cast("int"), F.lit(0)).alias("width"), F.coalesce(number(video["height"]).cast("int"), F.lit(0)).alias("height"),
        F.coalesce(video["codec_name"], F.lit("")).alias("vcodec"), F.floor(rate / 1000).cast("long").alias("bitrate_kbps"),
        F.transform(F.filter(streams, lambda s: s["codec_type"] == "audio"), track).alias("audio_tracks"),
    ).cast(schema.PROBE)


def parse_fingerprint(output: Column) -> Column:
    """The numbers of the FINGERPRINT= line, as unsigned 32-bit values; empty without such a line."""
    line = F.regexp_extract(output, r"(?m)^FINGERPRINT=([0-9,\-]*)", 1)
    return F.when(line == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(line, ","), lambda x: x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def longer_fingerprint(first: Column, again: Column) -> Column:
    """What stays if a failed extraction is repeated: the longer one."""
    return F.when(F.coalesce(F.size(again), F.lit(0)) > F.coalesce(F.size(first), F.lit(0)), again).otherwise(first)


#: Samples a second that fingerprints are made from.
FINGERPRINT_RATE = 11025


def mono_samples(samples: Column, channels: Column, rate: Column, target: int = FINGERPRINT_RATE) -> Column:
    """Interleaved samples as one channel at the target rate, for a fingerprint where the tool can't read the file itself: the mean
    of the channels, rounded down, at the nearest earlier moment."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    n = F.floor(frames.cast("long") * target / rate).cast("int")
    at = lambda i: (F.floor(i.cast("long") * rate / target) * channels).cast("int")
    mean = lambda i: F.floor(F.aggregate(F.slice(samples, at(i) + 1, channels), F.lit(0).cast("long"), lambda a, x: a + x) / channels)
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), mean))


def alignment_from_json(body: Column) -> Column:
    """Stored evidence of an alignment: unknown fields are left out, missing ones and empty evidence count as zero."""
    found = F.from_json(body, schema.ALIGNMENT)
    zero = {"double": F.lit(0.0), "int": F.lit(0), "boolean": F.lit(False)}
    fields = [x.split(":") for x in schema.ALIGNMENT[len("struct<") : -1].split(",")]
    return F.struct(*[F.coalesce(found[name], zero[kind]).alias(name) for name, kind in fields])


def decode_method(size_bytes: Column, height: Column, seek_above_gb: float, seek_height: int) -> Column:
    return F.when((size_bytes > seek_above_gb * 1e9) | (height >= seek_height), "seek").otherwise("demux")


# --- quality ----------------------------------------------------------------


def effective_bitrate(codec: Column, kbps: Column) -> Column:
    return F.coalesce(kbps, F.lit(0)) * F.coalesce(lookup(CODEC_EFFICIENCY, F.lower(F.trim(F.coalesce(codec, F.lit(""))))), F.lit(1.0))


def bitrate_cam(kbps: Column, width: Column, height: Column) -> Column:
    """How far bits per pixel fall short of a clean copy's, 0 to 1; null if any part is unknown."""
    bpp = kbps * 1000 / (width * height * 24.0)
    return F.when((kbps > 0) & (width > 0) & (height > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(TARGET_BPP) - bpp) / TARGET_BPP)))


def cam_score(*parts: Column) -> Column:
    """Mean of the parts that are known, 0.0 if none is."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(known) == 0, 0.0).otherwise(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def grade_distance(a: Column, b: Column) -> Column:
    """Mean relative difference of cast, saturation and contrast."""
    part = lambda n: F.abs(a[n] - b[n]) / (F.greatest(F.abs(a[n]), F.abs(b[n])) + 1e-6)
    return (part("cast") + part("saturation") + part("contrast")) / 3.0


def coverage_points(duration: Column) -> Column:
    """Sample points of an audio presence probe: one per two minutes, 8 to 48."""
    return F.when(duration <= 0, 8).otherwise(F.least(F.lit(48), F.greatest(F.lit(8), F.ceil(duration / 120)))).cast("int")


def fingerprint_coverage(items: Column, duration: Column, cap: Column, items_per_s: float = 8.0) -> Column:
    """Share of the (capped) duration that a fingerprint of so many items covers; 1.0 where the duration is unknown."""
    whole = F.when(cap > 0, F.least(duration, cap)).otherwise(duration)
    return F.when(whole <= 0, 1.0).otherwise(F.least(F.lit(1.0), items / items_per_s / whole))


def fingerprint_cap(duration: Column, cap: float, above: float) -> Column:
    """Seconds of audio to fingerprint; 0 means all of it."""
    return F.when(F.lit(cap <= 0) | ((duration > 0) & (duration <= above)), 0.0).otherwise(F.lit(float(cap)))


def region_starts(duration: Column, n: int, length: float) -> Column:
    """Starts of n regions spread evenly over a duration, so that each fits."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.greatest(F.lit(0.0), F.least(duration * i / (n + 1), duration - length)))


def iso3(language: Column) -> Column:
    return F.coalesce(lookup(ISO3, F.lower(language)), language)


def long_coverage(coverage: Column, a: Column, b: Column) -> Column:
    """Aligned share of the longer side."""
    return F.when(F.greatest(a, b) > 0, coverage * (F.least(a, b) / F.greatest(a, b))).otherwise(coverage)


def cut_density(cuts: Column, duration: Column) -> Column:
    return F.when(duration > 0, cuts / duration).otherwise(0.0)


def is_same(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(*SAME_LABELS)


def verdict_rank(verdict: Column) -> Column:
    return F.coalesce(lookup(VERDICT_RANK, verdict), F.lit(0))


def frame_times(n: Column, fps: float) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / F.lit(fps))


# --- display ----------------------------------------------------------------


def resolution_text(height: Column) -> Column:
    return F.when(height > 0, F.concat(height.cast("string"), F.lit("p"))).otherwise("?")


def audio_note(coverage: Column, duration: Column, ok: float) -> Column:
    clock = lambda s: F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    heard, whole = F.floor(coverage * duration).cast("long"), F.floor(duration).cast("long")
    return F.when(coverage >= ok, "").when(coverage <= 0.001, ", no audio").otherwise(F.concat(F.lit(", audio ends ~"), clock(heard), F.lit(" of "), clock(whole)))


def notification(title: Column, copies: Column, keep: Column) -> Column:
    return F.format_string("%s: %d copies, keep %s", title, copies, keep)


def problem_text(error: Column, note: Column, category: Column, coverage: Column, duration: Column) -> Column:
    """Why a file is listed: the repair note over the error; for an audio warning, the minutes that are silent."""
    silent = F.round((1 - coverage) * duration / 60).cast("long")
    return F.coalesce(note, error, F.when(coverage < 0.85, F.concat(F.lit("audio missing for about "), silent.cast("string"), F.lit(" min"))), category)


def cluster_title(keep: Column, members: Column) -> Column:
    """The kept file's title, or the first member's."""
    return clean_title(F.coalesce(keep, F.element_at(F.sort_array(members), 1)))


def deletable(members: Column, keep: Column) -> Column:
    """Members that may go: all but the kept one, and none while nothing is kept."""
    return F.when(keep.isNull(), F.array().cast("array<string>")).otherwise(F.filter(members, lambda m: m != keep))
