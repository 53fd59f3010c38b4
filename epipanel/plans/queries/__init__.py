"""Every query of the catalogue; importing this package fills it."""

from importlib import import_module
from pkgutil import iter_modules

for _m in sorted(iter_modules(__path__), key=lambda m: m.name):
    import_module(f"{__name__}.{_m.name}")
