"""Write semantics as DataFrame functions, and the thin writers on top."""
