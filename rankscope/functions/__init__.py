"""Column -> Column functions (all JVM-side built-ins, no Python UDFs)."""

from rankscope.functions.text import *  # noqa: F401,F403
from rankscope.functions.numeric import *  # noqa: F401,F403
