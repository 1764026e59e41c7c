"""What annotations and decorators of known frameworks mean, as data."""

from __future__ import annotations

# Annotation or decorator name -> (framework, HTTP method; None where an argument names it).
ROUTE_ANNOTATIONS = {
    "GetMapping": ("spring", "GET"), "PostMapping": ("spring", "POST"), "PutMapping": ("spring", "PUT"), "DeleteMapping": ("spring", "DELETE"), "PatchMapping": ("spring", "PATCH"), "RequestMapping": ("spring", None),
    "Get": ("nestjs", "GET"), "Post": ("nestjs", "POST"), "Put": ("nestjs", "PUT"), "Delete": ("nestjs", "DELETE"), "Patch": ("nestjs", "PATCH"), "All": ("nestjs", "ALL"),
}
ROUTE_PREFIX_ANNOTATIONS = ("RequestMapping", "Controller", "RestController")
#: Methods of a router object: app.get("/path"), router.post("/path"), app.route("/path").
ROUTER_METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "route", "websocket")
ENTRY_ANNOTATIONS = {
    "KafkaListener": "messaging", "RabbitListener": "messaging", "JmsListener": "messaging", "SqsListener": "messaging", "MessagePattern": "messaging",
    "Scheduled": "scheduler", "Cron": "scheduler", "Interval": "scheduler", "EventListener": "event", "TransactionalEventListener": "event", "OnEvent": "event", "EventPattern": "event",
    "Test": "test", "ParameterizedTest": "test", "BeforeEach": "test", "AfterEach": "test", "fixture": "test", "task": "messaging", "shared_task": "messaging", "command": "cli",
}
ADVICE_ANNOTATIONS = ("Before", "After", "Around", "AfterReturning", "AfterThrowing")
INJECT_ANNOTATIONS = {"Autowired": "spring", "Inject": "jakarta", "Resource": "jakarta"}
BEAN_ANNOTATIONS = ("Component", "Service", "Repository", "Controller", "RestController", "Configuration", "Injectable")
PROXY_ANNOTATIONS = {"Transactional": "transactional", "Async": "async", "Cacheable": "cache"}
LISTENER_ANNOTATIONS = {"EventListener": "event", "TransactionalEventListener": "event", "KafkaListener": "topic", "RabbitListener": "queue", "OnEvent": "emitter"}
PUBLISH_CALLS = {"publishEvent": "event", "convertAndSend": "queue", "send": "topic", "emit": "emitter"}
TRANSACTIONAL_PHASE = "AFTER_COMMIT"
REFLECTIVE_CALLS = {"forName": "type", "getattr": "member", "import_module": "module", "__import__": "module"}

# Annotations and decorators that change how what they mark runs.
DECORATORS = (
    "Transactional", "Cacheable", "CachePut", "CacheEvict", "Async", "Retryable", "Secured", "PreAuthorize", "RolesAllowed", "Timed", "Scheduled", "Loggable", "Measured", "RateLimit", "Idempotent", "Validated",
    "app", "router", "route", "get", "post", "put", "delete", "patch", "api_view", "action", "shared_task", "task", "celery", "command", "option", "login_required", "permission_classes", "authentication_classes",
    "cache_page", "lru_cache", "cache", "wraps", "contextmanager", "asynccontextmanager", "property", "staticmethod", "classmethod", "abstractmethod", "pytest", "fixture",
    "Controller", "Injectable", "Component", "Directive", "Pipe", "Guard", "Interceptor", "Middleware", "UseGuards", "UseInterceptors", "UsePipes", "UseFilters", "SetMetadata", "HttpCode", "Header", "Input", "Output",
    "HostListener", "ViewChild", "memo", "autobind", "debounce", "throttle", "observable", "computed", "effect", "transactional",
)

# File extensions of each language, and names that a language brings along.
EXTENSIONS = {".java": "java", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
PYTHON_BUILTINS = ("print", "len", "range", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "isinstance", "super", "open", "sorted", "min", "max", "sum", "any", "all", "zip", "map", "filter", "enumerate", "repr", "type", "iter", "next", "hasattr", "setattr", "abs", "round")
SCRIPT_GLOBALS = ("console", "JSON", "Math", "Object", "Array", "Promise", "Number", "String", "Date", "process", "parseInt", "parseFloat", "setTimeout", "require", "Reflect", "Symbol", "Map", "Set", "Error")
EXCLUDED_DIRS = ("node_modules", ".git", "dist", "build", "target", "out", "venv", ".venv", "__pycache__", ".idea", ".vscode", "coverage")
