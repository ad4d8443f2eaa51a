"""Host and path of a url by the URL standard, for urls that are not plain."""
from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

#: Fixed values of the standard.
SPECIAL = {"http", "https", "ws", "wss", "ftp", "file"}
FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|")
FORBIDDEN_DOMAIN = FORBIDDEN_HOST | {"%", "\x7f"} | {chr(c) for c in range(32)}
PATH_SET = set(' "#<>?^`{}')
SINGLE, DOUBLE = {".", "%2e"}, {"..", ".%2e", "%2e.", "%2e%2e"}
#: Letters that a name keeps, though they have a compatible form.
KEPT = "ßς\u200c\u200d"


class Unparsable(ValueError):
    pass


def encoded(text: str, also: set[str]) -> str:
    """Percent encoding of controls, what is not ASCII, and the characters of `also`."""
    return "".join(c if " " <= c < "\x7f" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def number(part: str) -> int:
    base = 10
    if part[:2].lower() == "0x":
        part, base = part[2:], 16
    elif len(part) > 1 and part[0] == "0":
        part, base = part[1:], 8
    if not part:
        return 0
    if not re.fullmatch({10: "[0-9]+", 8: "[0-7]+", 16: "[0-9A-Fa-f]+"}[base], part):
        raise Unparsable(part)
    return int(part, base)


def ipv4(host: str) -> str | None:
    """Dotted form of a host that ends in a number; none for names."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch("[0-9]+|0[xX][0-9A-Fa-f]*", parts[-1]):
        return None
    if len(parts) > 4 or "" in parts:
        raise Unparsable(host)
    numbers = [number(p) for p in parts]
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise Unparsable(host)
    value = numbers[-1] + sum(n * 256 ** (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def ipv6(packed: bytes) -> str:
    """Pieces in hexadecimal, the longest run of zeros (two at least, the first of equals) left out."""
    pieces = [f"{packed[k] << 8 | packed[k + 1]:x}" for k in range(0, 16, 2)]
    runs = [(j - i, -i) for i in range(8) for j in range(i + 2, 9) if set(pieces[i:j]) == {"0"}]
    if not runs:
        return ":".join(pieces)
    size, start = max(runs)[0], -max(runs)[1]
    return ":".join(pieces[:start]) + "::" + ":".join(pieces[start + size :])


def label(text: str) -> str:
    """One part of a name in ASCII."""
    text = "".join(c if c in KEPT else unicodedata.normalize("NFKC", c).lower() for c in text if c != "\u00ad")
    text = unicodedata.normalize("NFC", text)
    if text.isascii():
        return text
    if any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs", "Zs") for c in text) or unicodedata.category(text[0]).startswith("M"):
        raise Unparsable(text)
    return "xn--" + text.encode("punycode").decode()


def host_of(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise Unparsable(text)
        try:
            if "%" in text:
                raise ValueError(text)
            return f"[{ipv6(ipaddress.IPv6Address(text[1:-1]).packed)}]"
        except ValueError as error:
            raise Unparsable(text) from error
    if not special:
        if FORBIDDEN_HOST & set(text):
            raise Unparsable(text)
        return encoded(text, set())
    name = unquote_to_bytes(text.encode("utf-8", "replace")).decode("utf-8", "replace")
    name = re.sub("[\u3002\uff0e\uff61]", ".", name)
    name = ".".join(label(p) if p else "" for p in name.split("."))
    if not name or FORBIDDEN_DOMAIN & set(name):
        raise Unparsable(text)
    return ipv4(name) or name


def authority(text: str, special: bool) -> str:
    text = text.rsplit("@", 1)[-1]
    end = text.rfind(":")
    if end > text.rfind("]"):
        port = text[end + 1 :]
        if port and (not re.fullmatch("[0-9]+", port) or int(port) > 65535):
            raise Unparsable(text)
        text = text[:end]
        if not text:
            raise Unparsable(text)
    if not text:
        if special:
            raise Unparsable(text)
        return ""
    return host_of(text, special)


def path_of(text: str, scheme: str) -> str:
    """A path after its dot segments, in percent encoding."""
    special = scheme in SPECIAL
    parts = re.split(r"[/\\]" if special else "/", text)
    if parts and parts[0] == "":
        parts = parts[1:]
    elif not text:
        return "/" if special else ""
    out: list[str] = []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part.lower() in DOUBLE:
            if out and not (scheme == "file" and len(out) == 1 and re.fullmatch("[A-Za-z]:", out[0])):
                out.pop()
            if last:
                out.append("")
        elif part.lower() in SINGLE:
            if last:
                out.append("")
        else:
            if scheme == "file" and not out and re.fullmatch("[A-Za-z][:|]", part):
                part = part[0] + ":"
            out.append(encoded(part, PATH_SET))
    return "/" + "/".join(out)


def parsed(url: str) -> tuple[str, str]:
    url = re.sub("[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    if not found:
        raise Unparsable(url)
    scheme, rest = found[1].lower(), url[found.end() :]
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    special = scheme in SPECIAL
    slash = r"/\\" if special else "/"
    if scheme == "file":
        if re.match(r"[/\\]{2}", rest):
            host, path = re.fullmatch(r"..([^/\\]*)(.*)", rest, re.S).groups()
            if re.fullmatch("[A-Za-z][:|]", host):  # a drive, not a host
                host, path = "", f"/{host}{path}"
            host = host_of(host, True) if host else ""
            return "" if host == "localhost" else host, path_of(path, scheme)
        return "", path_of(rest, scheme)
    if special:
        rest = rest.lstrip("/\\")
    elif rest.startswith("//"):
        rest = rest[2:]
    elif rest.startswith("/"):
        return "", path_of(rest, scheme)
    else:
        return "", encoded(rest, set())
    host, path = re.fullmatch(rf"([^{slash}]*)(.*)", rest, re.S).groups()
    return authority(host, special), path_of(path, scheme)


def key(url: str) -> str | None:
    """host + path, or none if the url can't be parsed."""
    try:
        return "".join(parsed(url))
    except Unparsable:
        return None
