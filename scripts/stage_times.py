"""Summarize a Spark event log (JSON lines): the slowest stages with their
task count, run time, shuffle read/write and spill.

usage: python scripts/stage_times.py EVENT_LOG_FILE_OR_FOLDER [top_n]
"""
import io
import json
import os
import sys


def _lines(path):
    """Lines of an event log: a file, or a rolling log folder (optionally zstd)."""
    files = [path] if os.path.isfile(path) else sorted(
        os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_"))
    for fp in files:
        if fp.endswith(".zstd"):
            import zstandard
            with open(fp, "rb") as raw:
                yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
        else:
            with open(fp) as f:
                yield from f


def main():
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages, jobs_desc = [], {}
    for line in _lines(path):
        e = json.loads(line)
        if e.get("Event") == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            for sid in e.get("Stage IDs", []):
                jobs_desc[sid] = (props.get("spark.job.description") or "")[:60]
        if e.get("Event") != "SparkListenerStageCompleted":
            continue
        info = e["Stage Info"]
        acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
        ms = (info.get("Completion Time", 0) or 0) - (info.get("Submission Time", 0) or 0)
        stages.append((ms, info["Stage ID"], info.get("Number of Tasks"), info.get("Stage Name", "")[:50],
                       acc.get("internal.metrics.shuffle.read.recordsRead", 0),
                       acc.get("internal.metrics.shuffle.write.bytesWritten", 0),
                       acc.get("internal.metrics.memoryBytesSpilled", 0)))
    print(f"{'ms':>7} {'stage':>5} {'tasks':>5} {'shuf_read_rec':>13} {'shuf_write_B':>12} {'spill_B':>9}  name")
    for ms, sid, n, name, rr, wb, sp in sorted(stages, reverse=True)[:top]:
        print(f"{ms:>7} {sid:>5} {n:>5} {rr:>13} {wb:>12} {sp:>9}  {name} {jobs_desc.get(sid, '')}")
    print("stages:", len(stages), "total stage ms:", sum(s[0] for s in stages))


if __name__ == "__main__":
    main()
