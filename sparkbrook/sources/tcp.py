"""Framed messages over TCP: a server that lands them in a queue, and a client that sends with retries.

The server writes what clients send to queue files, which the ``framed`` source reads: the network part can fail and restart without the stream's
positions being lost.
"""

from __future__ import annotations

import socket
import socketserver
import threading
import time

from .codec import RECORD, frame, frames
from .queue_files import QueueWriter

HOST, PORT, READ, LIMIT = "127.0.0.1", 5565, 32 << 10, (8 << 20) + 256


class FramedServer:
    """Accepts any number of clients; every whole frame is appended to the queue, in order per client. A client's buffer holds no more than ``limit`` bytes and what was read last."""

    def __init__(self, writer: QueueWriter, host: str = HOST, port: int = PORT, limit: int = LIMIT):
        lock = threading.Lock()

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                data = b""
                while chunk := self.request.recv(READ):
                    data += chunk
                    used = 0
                    with lock:
                        for offset, _, payload in frames(data):
                            writer.append(payload)
                            used = offset + len(frame(payload))
                        writer.flush()
                    data = data[used:]
                    if data and RECORD not in data:
                        data = b""
                    elif len(data) > limit:  # no frame is as long: go on at the next mark
                        data = data[max(data.find(RECORD, 1), 0) or len(data) :]

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address = True
            daemon_threads = True

        self.server = Server((host, port), Handler)
        self.port = self.server.server_address[1]
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def send(payloads: list[bytes], host: str = HOST, port: int = PORT, *, wait: float = 1.0, tries: int | None = None) -> int:
    """Send frames in order; after a closed or slow connection, wait and go on with the same message, for ever or ``tries`` times. Messages sent."""
    done, left, link = 0, tries, None
    while done < len(payloads):
        try:
            if link is None:
                link = socket.create_connection((host, port), timeout=10)
            link.sendall(frame(payloads[done]))
            done += 1
        except OSError:
            link = None
            if left is not None:
                left -= 1
                if left <= 0:
                    return done
            time.sleep(wait)
    if link is not None:
        link.close()
    return done
