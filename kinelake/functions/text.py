"""Strings and JSON: captions, model outputs, request records, names. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field names under which a box may stand, in order of preference.
BOX_KEYS = ("bbox_2d", "bbox", "box")
BOX = "struct<bbox_2d:array<double>,bbox:array<double>,box:array<double>,label:string>"
POINT = "struct<point_2d:array<double>,label:string>"
INTERVAL = "struct<start:string,end:string,caption:string>"
#: Sizes that requests name, by resolution.
SIZES = {"720": (1280, 720), "256": (448, 256)}


def caption(c: Column) -> Column:
    """What follows the last colon, trimmed."""
    return F.trim(F.element_at(F.split(c, ":"), -1))


def json_part(c: Column) -> Column:
    """The first bracketed part of a text without code fences, from its first opening to its last closing bracket."""
    bare = F.regexp_replace(c, r"```[A-Za-z]*", "")
    return F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1)


def _listed(text: Column) -> Column:
    return F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)


def parse_boxes(c: Column, required: bool = True) -> Column:
    """array<struct<box, label>> of a fenced or bare JSON answer; one object counts as a list of one. What cannot be read
    is an error if required, else null."""
    items = F.from_json(_listed(json_part(c)), f"array<{BOX}>", {"mode": "PERMISSIVE"})
    boxes = F.transform(items, lambda x: F.struct(F.coalesce(*[x[k] for k in BOX_KEYS]).alias("box"), x["label"].alias("label")))
    if not required:
        return boxes
    return F.coalesce(boxes, F.raise_error(F.concat(F.lit("no boxes in: "), F.coalesce(c, F.lit("null")))).cast("array<struct<box:array<double>,label:string>>"))


def parse_boxes_tolerant(c: Column, width: Column, height: Column) -> Column:
    """As parse_boxes, of what follows the first thinking mark; null if nothing is found. Items without exactly four numbers
    are left out, and boxes whose numbers are all 1000 at most are rescaled."""
    after = F.when(F.instr(c, "</think>") > 0, F.substr(c, F.instr(c, "</think>") + len("</think>"))).otherwise(c)
    boxes = F.filter(parse_boxes(after, required=False), lambda x: x["box"].isNotNull() & (F.size(x["box"]) == 4))
    return F.transform(boxes, lambda x: F.struct(F.when(F.forall(x["box"], lambda v: F.abs(v) <= 1000), rescale(x["box"], width, height)).otherwise(x["box"]).alias("box"), x["label"].alias("label")))


def parse_points(c: Column) -> Column:
    """array<struct<point, label>> of what follows the last thinking mark."""
    last = F.element_at(F.split(c, "</think>"), -1)
    items = F.from_json(_listed(json_part(last)), f"array<{POINT}>")
    return F.transform(items, lambda x: F.struct(x["point_2d"].alias("point"), x["label"].alias("label")))


def rescale(numbers: Column, width: Column, height: Column) -> Column:
    """x and y in turn, from thousandths to pixels."""
    return F.transform(numbers, lambda v, i: v / 1000.0 * F.when(i % 2 == 0, width).otherwise(height))


def seconds(c: Column) -> Column:
    """Seconds from a number, or from minutes and seconds (``mm:ss.ff``, or with hours before)."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda x: F.expr("0.0D") + x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60.0 + x)


def parse_intervals(c: Column) -> Column:
    """array<struct<start, end, caption>> in seconds."""
    items = F.from_json(_listed(json_part(c)), f"array<{INTERVAL}>")
    return F.transform(items, lambda x: F.struct(seconds(x["start"]).alias("start"), seconds(x["end"]).alias("end"), x["caption"].alias("caption")))


def iteration(name: Column) -> Column:
    """The number of a directory ``iter_000004000``, in base 10; null for other names."""
    return F.regexp_extract(name, r"^iter_(\d+)/?$", 1).try_cast("long")


def episode_of(file_name: Column) -> Column:
    """The number after the last underscore of a Parquet file's name; null if there is none."""
    return F.regexp_extract(file_name, r"_(\d+)\.parquet$", 1).try_cast("long")


def statistics_file(tag: Column, postfix: str | None, special: str, optional: bool = False) -> Column:
    """The statistics file of an embodiment: one name for the special tag, another for the rest. Without a postfix this is
    an error, unless optional."""
    if not postfix and not optional:
        raise ValueError("a statistics postfix is needed")
    tail = f"_{postfix}" if postfix else ""
    return F.when(F.lower(F.trim(tag)) == special, F.lit(f"stats_cmr{tail}.json")).otherwise(F.lit(f"stats{tail}.json"))


def arm(key: Column) -> Column:
    low = F.lower(key)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right")


def compact(json: Column, schema: str) -> Column:
    return F.to_json(F.from_json(json, schema))


def effective_fps(raw: Column, stride: Column) -> Column:
    """round(raw / stride), half to even; 30 where raw is missing."""
    return F.rint(F.coalesce(raw, F.lit(30.0)) / F.greatest(F.lit(1), stride)).cast("long")


def image_to_video_request(name: Column, prompt: Column, negative: Column, image: Column, mode: str = "image2video", resolution: str = "720", aspect: str = "16:9", fps: int = 24, frames: int = 189, seed: int = 0, steps: int = 35, guidance: float = 6.0, shift: float = 10.0) -> Column:
    """A JSON line of a generation request. The image is named for image2video only."""
    fields = {
        "aspect_ratio": F.lit(aspect), "fps": F.lit(fps), "guidance": F.lit(guidance), "model_mode": F.lit(mode), "name": name, "negative_prompt": negative, "num_frames": F.lit(frames), "num_outputs": F.lit(1),
        "num_steps": F.lit(steps), "prompt": prompt, "resolution": F.lit(resolution), "seed": F.lit(seed), "shift": F.lit(shift), "vision_path": image if mode == "image2video" else F.lit(None).cast("string"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def generation_payload(prompt: Column, negative: Column, resolution: str, aspect: str = "16:9") -> Column:
    """prompt, negative_prompt, width and height; sizes are known for 16:9 only."""
    if resolution not in SIZES or aspect != "16:9":
        raise ValueError(f"no size for {resolution} at {aspect}")
    w, h = SIZES[resolution]
    return F.to_json(F.struct(prompt.alias("prompt"), negative.alias("negative_prompt"), F.lit(w).alias("width"), F.lit(h).alias("height")))


def request_form(prompt: Column, frames: Column, fps: Column, sound: bool) -> Column:
    """A form of texts: the sound's length in seconds, to three digits, only with sound."""
    fields = [prompt.alias("prompt"), frames.cast("string").alias("num_frames"), fps.cast("string").alias("fps"), F.lit(str(sound).lower()).alias("enable_sound")]
    if sound:
        fields.append(F.format_string("%.3f", frames.cast("double") / fps.cast("double")).alias("sound_duration"))
    return F.struct(*fields)


def inverse_dynamics_form(prompt: Column, chunk: Column) -> Column:
    """A form that asks for one frame more than a chunk of actions."""
    return F.struct(prompt.alias("prompt"), (chunk + 1).cast("string").alias("num_frames"), chunk.cast("string").alias("action_chunk_size"))


def forward_dynamics_request(name: Column, prompt: Column, vision: Column, action: Column, chunk: int, domain: str, view: str, fps: int = 10, image_size: int = 256, seed: int = 0) -> Column:
    fields = {
        "action_chunk_size": F.lit(chunk), "action_path": action, "domain_name": F.lit(domain), "fps": F.lit(fps), "image_size": F.lit(image_size), "view_point": F.lit(view),
        "model_mode": F.lit("forward_dynamics"), "name": name, "prompt": prompt, "seed": F.lit(seed), "vision_path": vision,
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def chat_message(role: Column, text: Column, video: Column | None = None) -> Column:
    """A role and its typed content parts."""
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("video_url"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text", text, none)) if video is None else F.array(part("video_url", none, video), part("text", text, none))
    return F.array(F.struct(role.alias("role"), parts.alias("content")))


def completed_action(response: Column) -> Column:
    """The action of a finished job's first output; an error if the job is done without one."""
    got = F.from_json(response, "struct<status:string,outputs:array<struct<content:struct<action:array<array<double>>>>>>")
    action = F.try_element_at(got["outputs"], F.lit(1))["content"]["action"]
    return F.when(got["status"] != "completed", F.lit(None)).otherwise(F.coalesce(action, F.raise_error(F.lit("a completed job has no action")).cast("array<array<double>>")))
