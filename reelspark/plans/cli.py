"""Command-line grammar to a job specification."""

from __future__ import annotations

import re

from .builder import MapSpec, PlanError, Spec


def parse_bitrate(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kKmM]?)\s*", text)
    if not m:
        raise PlanError(f"bad bit rate {text}")
    return int(float(m[1]) * {"": 1, "k": 1_000, "m": 1_000_000}[m[2].lower()])


def parse_map(text: str) -> MapSpec:
    m = re.fullmatch(r"(\d+)(?::([vVa]|\d+))?", text)
    if not m:
        raise PlanError(f"bad map {text}")
    what = m[2]
    if what is None:
        return MapSpec(int(m[1]))
    if what in "vV":
        return MapSpec(int(m[1]), "video")
    return MapSpec(int(m[1]), "audio") if what == "a" else MapSpec(int(m[1]), "index", int(what))


def parse_args(args: list[str]) -> Spec:
    """``[-y] [-f fmt] -i in ... [-map m] [-c[:v|:a] codec] [-vf chain]
    [-filter_complex g] [-b[:v|:a] rate] [-frames[:v] n] out``.

    Options before the first ``-i`` bind to inputs, later ones to the output.
    Unknown options raise; a bit rate means the same everywhere."""
    inputs: list[str] = []
    out: dict = {"maps": [], "options": {}}
    rest = list(args)
    output = None

    def value(opt):
        if not rest:
            raise PlanError(f"{opt} needs a value")
        return rest.pop(0)

    while rest:
        a = rest.pop(0)
        if a == "-i":
            inputs.append(value(a))
        elif a in ("-y", "-n"):
            out["overwrite"] = a == "-y"
        elif a == "-f":
            out["output_format" if inputs else "input_format"] = value(a)
        elif a == "-map":
            out["maps"].append(parse_map(value(a)))
        elif a in ("-c", "-codec"):
            out["video_codec"] = out["audio_codec"] = value(a)
        elif a in ("-c:v", "-codec:v", "-vcodec"):
            out["video_codec"] = value(a)
        elif a in ("-c:a", "-codec:a", "-acodec"):
            out["audio_codec"] = value(a)
        elif a in ("-vf", "-filter:v"):
            out["video_filter"] = value(a)
        elif a == "-filter_complex":
            out["filter_complex"] = value(a)
        elif a in ("-b", "-b:v"):
            out["video_bitrate"] = parse_bitrate(value(a))
        elif a == "-b:a":
            out["audio_bitrate"] = parse_bitrate(value(a))
        elif a in ("-frames", "-frames:v", "-vframes"):
            n = value(a)
            if not n.isdigit():
                raise PlanError(f"bad frame count {n}")
            out["frames"] = int(n)
        elif a in ("-vn", "-an"):
            out["options"][a[1:]] = "1"
        elif a.startswith("-") and len(a) > 1 and rest and re.fullmatch(r"-(q|qp|crf|speed|preset|compression_level)(:[va])?", a):
            out["options"][a[1:].split(":")[0]] = value(a)
        elif a.startswith("-") and len(a) > 1:
            raise PlanError(f"unknown option {a}")
        elif output is None:
            output = a
        else:
            raise PlanError("only one output")
    if not inputs:
        raise PlanError("no input")
    if output is None:
        raise PlanError("no output")
    out.pop("input_format", None)
    return Spec(inputs=tuple(inputs), output=output, maps=tuple(out.pop("maps")), **out)
