from .compare import compare  # noqa: F401
from .render import pipe_line, render  # noqa: F401
