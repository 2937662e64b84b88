"""Media columns: MPEG audio streams that carry bytes, and a reader for any such stream.

``wrap`` stores a payload in MPEG-1 Layer III frames (48 kHz, mono, checksum
on). Each frame has zeroed side information, so it decodes to silence, and
the payload stands in the part of the frame that follows. A tag with the
payload length and a table frame for variable bitrate (frame count, byte
count, seek points) come first. ``read`` resynchronises on frame headers,
parses tags (versions 2.2 to 2.4, and the 128 bytes at the end), verifies the
checksums of all three layers, reads the table (frames, bytes, quality, seek
points, of either kind), and returns exact sample counts and the offset of
every frame.

Defined results: null text is an empty payload; every payload is padded with
zero bytes to a positive multiple of 64; equal texts give equal streams;
bytes without a single frame read as an empty track; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of the format: bitrates in kbit/s by (version 1, layer) and index, sample rates by index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
OWNER = b"lumenframe/payload"
HEAD = 4 + 2 + 17


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    #: Sub-bands from this one on share their bit allocation (joint stereo).
    bound: int

    @property
    def side(self) -> int:
        """Bytes of side information, Layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The frame header in these four bytes, if it is one with a stated bitrate."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    kbit, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hertz, pad = BITRATES[version == 3, layer][kbit], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, size, samples, bound)


@lru_cache(65536)
def checksum(covered: bytes, bits: int | None = None) -> int:
    """Checksum of these bytes, or of that many leading bits."""
    crc = 0xFFFF
    for at in range(8 * len(covered) if bits is None else bits):
        top = crc >> 15 ^ covered[at >> 3] >> (7 - (at & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


def _allocation(h: Header) -> list[int]:
    """Layer II: bits of the allocation of each sub-band."""
    if h.version != 3:
        runs = ((4, 4), (7, 3), (19, 2))
    else:
        kbps = h.kbps if h.mono else h.kbps // 2
        if kbps <= 48:
            runs = ((2, 4), (10 if h.rate == 32000 else 6, 3))
        else:
            runs = ((11, 4), (12, 3), (4 if kbps <= 80 or h.rate == 48000 else 7, 2))
    return [bits for count, bits in runs for _ in range(count)]


def covered_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: side information, or allocations (and scale factor selectors, Layer II)."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(h.bound, 32))
    value, size, at, selectors = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for band, bits in enumerate(_allocation(h)):
        for _ in range(channels if band < h.bound else 1):
            used = at + bits <= size and value >> (size - at - bits) & ((1 << bits) - 1)
            selectors += 2 * bool(used) * (1 if band < h.bound else channels)
            at += bits
    return at + selectors


def sound_checksum(h: Header, frame: bytes) -> bool:
    """Whether a protected frame's checksum holds."""
    bits = covered_bits(h, frame[6:])
    if 48 + bits > 8 * len(frame):
        return False
    return checksum(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame_head(index: int) -> bytes:
    four = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return four + struct.pack(">H", checksum(four[2:] + side)) + side


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: 3 * BITRATES[True, 3][i] - HEAD for i in range(1, 15)}


def pad(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def wrap(payload: bytes) -> bytes:
    frames, at, top = [], 0, _ROOM[14]
    while at < len(payload):
        left = len(payload) - at
        index = 14 if left >= top else next(i for i in range(1, 15) if _ROOM[i] >= left)
        body = payload[at : at + _ROOM[index]]
        frames.append(_HEADS[index] + body + bytes(_ROOM[index] - len(body)))
        at += len(body)
    sizes = [144, *map(len, frames)]
    total = sum(sizes)
    starts = [0]
    for s in sizes[:-1]:
        starts.append(starts[-1] + s)
    toc = bytes(min(255, 256 * starts[min(len(sizes) - 1, i * len(sizes) // 100)] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 0b111, len(frames), total) + toc
    first = _HEADS[3] + table
    private = OWNER + b"\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + first + bytes(144 - len(first)) + b"".join(frames)


@dataclass
class Track:
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    #: Byte position, as the table states it, where each part of equal duration begins.
    seek: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    bodies: list[bytes] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        body = b"".join(self.bodies)
        length = self.tags.get("PRIV", b"")
        return body[: struct.unpack(">Q", length[-8:])[0]] if length.startswith(OWNER) else body


def _number(raw: bytes, bits: int = 8) -> int:
    """Big-endian number, of 7 bits a byte where it is free of sync bits."""
    n = 0
    for x in raw:
        n = n << bits | x & (1 << bits) - 1
    return n


def _tag_frames(version: int, flags: int, body: bytes, track: Track) -> None:
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and version == 3:
        p = 4 + _number(body[:4])
    elif flags & 0x40 and version == 4:
        p = _number(body[:4], 7)
    name, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        n = _number(body[p + name : p + 2 * name], 7 if version == 4 else 8)
        track.tags[body[p : p + name].decode("latin-1")] = body[p + head : p + head + n]
        p += head + n


def _tags(data: bytes, track: Track) -> tuple[int, int]:
    """Where the frames begin and end, after the tags at either end are read."""
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        version, flags = data[at + 3], data[at + 5]
        stop = min(end, at + 10 + _number(data[at + 6 : at + 10], 7))
        if version in (2, 3, 4):
            _tag_frames(version, flags, data[at + 10 : stop], track)
        # a footer repeats the head
        at = min(end, stop + 10) if version == 4 and flags & 0x10 else stop
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        for name, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
            track.tags.setdefault(name, data[end - 128 + lo : end - 128 + hi].rstrip(b"\0 "))
        end -= 128
    return at, end


def _table(body: bytes, frame: bytes, track: Track) -> bool:
    """Read the variable-bitrate table that a first frame may hold in place of sound."""
    if body[:4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(body[4:8], "big"), 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek_points", 100), (8, "quality", 4)):
            if flags & bit:
                raw = body[p : p + size]
                if name == "seek_points":
                    total = track.table.get("bytes", 0)
                    track.seek = [x * total // 256 for x in raw]
                    track.table[name] = len(raw)
                else:
                    track.table[name] = int.from_bytes(raw, "big")
                p += size
        track.table.setdefault("seek_points", 0)
        return True
    v = frame[36:]
    if v[:4] == b"VBRI" and len(v) >= 26:
        quality, size, frames = struct.unpack(">HII", v[8:18])
        entries, scale, width, _ = struct.unpack(">HHHH", v[18:26])
        track.table |= {"frames": frames, "bytes": size, "quality": quality, "seek_points": entries}
        for k in range(entries):
            part = int.from_bytes(v[26 + k * width : 26 + (k + 1) * width], "big") * scale
            track.seek.append((track.seek[-1] if track.seek else 0) + part)
        return True
    return False


def read(data: bytes) -> Track:
    """Parse a stream; a header counts if its frame ends at another header or at the end of the data."""
    track = Track()
    at, end = _tags(data, track)
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h and (at + h.size == end or at + h.size + 4 <= end and header(data[at + h.size : at + h.size + 4]))
        if not h or not follows:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            track.skipped += nxt - at
            at = nxt
            continue
        head = 4 + 2 * h.checked + (h.side if h.layer == 3 else 0)
        track.bad_checksums += h.checked and not sound_checksum(h, data[at : at + h.size])
        body = data[at + head : at + h.size]
        if track.offsets or track.table or h.layer != 3 or not _table(body, data[at : at + h.size], track):
            track.offsets.append(at)
            track.kbps.append(h.kbps)
            track.bodies.append(body)
            track.samples += h.samples
            track.rate = h.rate
        at += h.size
    track.skipped += end - at if at < end else 0
    return track
