"""Fixed values that results depend on: word lists, lookup tables, limits."""

from __future__ import annotations

# ---- fixed values: closed string domains ---------------------------------
PROTOCOLS = ["rest", "grpc", "websocket", "mqtt", "kafka", "zeromq", "mavlink", "amqp",
             "file", "socket", "process", "database", "unknown"]
LOGICAL_TYPES = ["str", "int", "float", "bool", "object", "array", "bytes"]
EVENT_TYPES = ["new_node", "node_gone", "contract_drift", "bridge_live", "bridge_torn",
               "adapter_reloaded", "synthesis_failed", "circuit_trip", "circuit_recover"]

# ---- fixed values: field alias -> canonical field name --------------------
FIELD_ALIASES = {
    "portid": "port", "port_id": "port",
    "dst_port": "destination.port", "src_port": "source.port",
    "src_ip": "source.address", "src_addr": "source.address", "source_ip": "source.address",
    "dst_ip": "destination.address", "dst_addr": "destination.address",
    "dest_ip": "destination.address", "remote_addr": "destination.address",
    "remote_ip": "destination.address",
    "ts": "timestamp", "time": "timestamp", "created": "timestamp", "created_at": "timestamp",
    "updated_at": "timestamp", "event_time": "timestamp", "log_time": "timestamp",
    "uid": "user.id", "userid": "user.id", "user_id": "user.id",
    "uname": "user.name", "username": "user.name",
    "lvl": "severity", "level": "severity", "log_level": "severity", "loglevel": "severity",
    "sev": "severity", "priority": "severity",
    "msg": "message", "log": "message", "text": "message", "body": "message", "content": "message",
    "proc": "process.name", "process": "process.name", "cmd": "process.name",
    "command": "process.name", "pid": "process.pid",
    "temp": "temperature", "temp_c": "temperature_celsius", "temp_f": "temperature_fahrenheit",
    "hum": "humidity", "humidity_pct": "humidity",
}

# ---- fixed values: severity words, labels, noise words --------------------
SEVERITY_LEVELS = {
    "trace": 0, "debug": 1, "info": 2, "notice": 2, "warning": 3, "warn": 3,
    "error": 4, "err": 4, "critical": 5, "crit": 5, "fatal": 5, "emergency": 5,
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5,
}
SEVERITY_LABELS = ["trace", "debug", "info", "warning", "error", "critical"]
DEFAULT_SEVERITY = 2
NOISE_WORDS = ["heartbeat", "keepalive", "ping", "noop", "alive", "ok\n", "ok\r"]
MESSAGE_ID_KEYS = ["id", "msg_id", "message_id", "uuid", "seq", "sequence"]

# ---- fixed values: protocol compatibility, one row per producer protocol ---
# columns: rest grpc websocket mqtt kafka zeromq mavlink amqp file socket process database unknown
PROTOCOL_COMPAT = {
    "rest":      [1.0, 0.6, 0.7, 0.5, 0.6, 0.5, 0.3, 0.6, 0.8, 0.5, 0.4, 0.7, 0.2],
    "grpc":      [0.6, 1.0, 0.5, 0.4, 0.5, 0.6, 0.3, 0.4, 0.5, 0.6, 0.4, 0.5, 0.2],
    "websocket": [0.7, 0.5, 1.0, 0.7, 0.6, 0.6, 0.4, 0.5, 0.4, 0.7, 0.3, 0.4, 0.2],
    "mqtt":      [0.5, 0.4, 0.7, 1.0, 0.8, 0.7, 0.6, 0.8, 0.4, 0.5, 0.3, 0.4, 0.2],
    "kafka":     [0.6, 0.5, 0.6, 0.8, 1.0, 0.7, 0.3, 0.8, 0.6, 0.5, 0.4, 0.7, 0.2],
    "zeromq":    [0.5, 0.6, 0.6, 0.7, 0.7, 1.0, 0.4, 0.6, 0.5, 0.7, 0.6, 0.4, 0.2],
    "mavlink":   [0.3, 0.3, 0.4, 0.6, 0.3, 0.4, 1.0, 0.3, 0.3, 0.5, 0.3, 0.3, 0.1],
    "amqp":      [0.6, 0.4, 0.5, 0.8, 0.8, 0.6, 0.3, 1.0, 0.5, 0.4, 0.3, 0.5, 0.2],
    "file":      [0.8, 0.5, 0.4, 0.4, 0.6, 0.5, 0.2, 0.5, 1.0, 0.5, 0.7, 0.7, 0.3],
    "socket":    [0.5, 0.6, 0.7, 0.5, 0.5, 0.7, 0.5, 0.4, 0.5, 1.0, 0.6, 0.4, 0.3],
    "process":   [0.4, 0.4, 0.3, 0.3, 0.4, 0.6, 0.2, 0.3, 0.7, 0.6, 1.0, 0.5, 0.3],
    "database":  [0.7, 0.5, 0.4, 0.4, 0.7, 0.4, 0.2, 0.5, 0.7, 0.4, 0.5, 1.0, 0.2],
    "unknown":   [0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.1, 0.2, 0.3, 0.3, 0.3, 0.2, 0.5],
}
DEFAULT_COMPAT = 0.2

# ---- fixed values: type compatibility, one row per source type ------------
# columns: str int float bool object array bytes
TYPE_COMPAT = {
    "str":    [1.0, 0.3, 0.3, 0.2, 0.5, 0.2, 0.4],
    "int":    [0.4, 1.0, 0.9, 0.5, 0.1, 0.1, 0.3],
    "float":  [0.4, 0.9, 1.0, 0.2, 0.1, 0.1, 0.3],
    "bool":   [0.3, 0.6, 0.3, 1.0, 0.1, 0.1, 0.2],
    "object": [0.3, 0.1, 0.1, 0.1, 1.0, 0.5, 0.2],
    "array":  [0.2, 0.1, 0.1, 0.1, 0.5, 1.0, 0.2],
    "bytes":  [0.5, 0.3, 0.3, 0.2, 0.2, 0.2, 1.0],
}

# ---- fixed values: semantic tag words, in tag order -----------------------
TAG_WORDS = {
    "geospatial": ["lat", "lon", "alt", "altitude", "gps", "position"],
    "market": ["price", "bid", "ask", "volume", "trade", "order"],
    "telemetry": ["sensor", "temperature", "humidity", "pressure", "imu"],
    "identity": ["user", "username", "email", "account", "auth", "token"],
    "time-series": ["timestamp", "time", "ts", "created_at", "updated_at"],
    "observability": ["log", "level", "message", "error", "trace"],
    "drone": ["frame", "seq", "mavlink", "sys_id", "comp_id"],
}
SHORT_TAG_WORDS = {
    "geospatial": ["lat", "lon", "alt", "gps"],
    "market": ["price", "bid", "ask", "volume"],
    "telemetry": ["temp", "sensor", "imu", "pressure"],
    "identity": ["user", "email", "token", "auth"],
    "observability": ["log", "level", "trace", "error"],
}
BROAD_TAGS = ["generic", "socket", "process", "data", "json", "stream"]
PROTOCOL_TAGS = ["grpc", "mqtt", "kafka", "websocket", "amqp", "zeromq", "rest", "http"]

# ---- fixed values: ports ---------------------------------------------------
PORT_PROTOCOLS = {
    "grpc": [50051, 50052, 50053, 50054],
    "rest": [8000, 8080, 8081, 8443, 3000, 4000, 5000, 7000, 9000, 9001],
    "kafka": [9092, 9093, 9094],
    "mqtt": [1883, 8883],
    "amqp": [5672, 5671],
}
SKIPPED_PORTS = [22, 25, 53, 67, 68, 111, 123, 137, 138, 139, 445, 389, 636, 631, 3306, 5432]
SCHEMES = {"grpc": "grpc", "mqtt": "mqtt", "kafka": "kafka", "websocket": "ws",
           "amqp": "amqp", "zeromq": "tcp", "rest": "http"}

# ---- fixed values: endpoints that are never bridged, first match wins ------
REFUSED_GLOBS = [
    "*oauth*", "*oidc*", "*saml*", "*auth/token*", "*login*", "*password*",
    "*credentials*", "*secrets*", "*/vault/*", "*/keyvault/*",
    "*/admin/*", "*/management/*", "*/actuator/*", "*:9090/admin*",
    "*/_cluster/*", "*/_cat/*",
    "*:22", "*:3389", "*:135", "*:5985", "*:5986",
    "*:5432/postgres", "*:3306/mysql", "*:27017/admin", "*:6379/admin*",
    "*:6443/*", "*:2375/*", "*:2376/*",
    "/proc/*", "/sys/*", "/dev/*",
    "*/internal/*", "*/private/*", "*/system/*",
]

# ---- fixed values: scores, limits and windows ------------------------------
SCORE_WEIGHTS = {"semantic": 0.40, "protocol": 0.20, "latency": 0.15, "risk": 0.15, "history": 0.10}
MIN_SCORE = 0.72
DRIFT_THRESHOLD = 0.15
HISTORY_PER_NODE = 256
ALIGN_THRESHOLD = 0.3
DECAY_PER_MINUTE = 0.95
MIN_DECAYED = 0.40
MAX_BRIDGES_PER_NODE = 16
MAX_ATTEMPTS = 10
ATTEMPT_WINDOW_S = 60
DEDUPE_TTL_S = 30
BREAKER_THRESHOLD = 0.40
BREAKER_WINDOW_S = 10
BREAKER_HALF_OPEN_S = 30
BREAKER_MIN_EVENTS = 5
HOLD_CAPACITY = 10_000
LATENCY_SAMPLES = 1000
REQUEST_LIMIT = 120
EMBED_BUCKETS = 4096
EMBED_DIM = 384
ADAPTER_VERSION = "0.1.0"
