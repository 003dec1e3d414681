"""shoplens.streaming"""
