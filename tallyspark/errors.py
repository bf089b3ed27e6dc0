"""The one error the library raises for input it cannot use."""


class UnusableInput(ValueError):
    """The data or its mapping lacks what an operator needs."""
